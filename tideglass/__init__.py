"""Credit-risk early-warning analytics expressed as Spark jobs."""
