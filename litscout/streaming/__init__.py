"""Incremental maintenance of the library with Structured Streaming."""
