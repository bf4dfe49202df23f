"""functions of the block engine."""
