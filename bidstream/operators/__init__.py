"""operators of the notice engine."""
