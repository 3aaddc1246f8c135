"""sources of the event-analytics engine."""
