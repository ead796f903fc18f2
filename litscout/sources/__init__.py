"""Readers: JSON payloads to candidate rows, files, and paged web interfaces as Python data sources."""
