"""sources of the notice engine."""
