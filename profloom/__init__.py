"""Performance-profile analytics as Spark jobs."""
