"""Incremental forms of the import and of the event-driven state."""
