"""A block-parallel bzip2 engine on Spark: every stage of the format is a DataFrame."""
