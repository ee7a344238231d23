"""Query registry and staging helpers."""
