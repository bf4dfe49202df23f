"""operators of the block engine."""
