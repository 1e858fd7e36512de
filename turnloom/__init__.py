"""Multi-turn session analytics as Spark jobs."""
