"""Content-safety and engineering-flow analytics as Spark jobs."""
