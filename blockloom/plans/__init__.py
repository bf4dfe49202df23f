"""plans of the block engine."""
