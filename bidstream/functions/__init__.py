"""functions of the notice engine."""
