"""Feature groups, alignment, signals, replay and analytics."""
