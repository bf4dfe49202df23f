"""sources of the block engine."""
