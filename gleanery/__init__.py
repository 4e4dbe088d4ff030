"""Content-ranking analytics on Spark."""
