"""Feeds, reports and notes. Items are rendered as Column expressions; only the top rows reach the driver."""
