"""Search and analysis of time-stamped media records as Spark jobs."""
