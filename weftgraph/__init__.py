"""Graph pattern analytics on Spark."""
