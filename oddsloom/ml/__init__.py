"""Model fits as Spark jobs."""
