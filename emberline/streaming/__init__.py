"""streaming of the event-analytics engine."""
