"""Document-corpus search, structure and evaluation as ordinary Spark DataFrame jobs."""
