"""functions of the event-analytics engine."""
