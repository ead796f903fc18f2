"""Whole plans: the watch pipeline, and the registered queries with their SQL."""
