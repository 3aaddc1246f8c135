"""operators of the event-analytics engine."""
