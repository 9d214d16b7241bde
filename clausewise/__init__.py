"""Document and policy knowledge-base analytics as Spark jobs."""
