"""Point-in-time research analytics expressed as Spark DataFrame jobs."""
