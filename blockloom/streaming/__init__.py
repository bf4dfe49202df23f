"""streaming of the block engine."""
