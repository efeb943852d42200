"""Model-probing analytics as Spark jobs."""
