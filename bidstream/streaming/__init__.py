"""streaming of the notice engine."""
