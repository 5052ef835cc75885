"""Dataset-quality analytics as Spark DataFrame jobs."""
