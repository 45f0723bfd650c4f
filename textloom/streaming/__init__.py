"""Event-time windows on streams."""
