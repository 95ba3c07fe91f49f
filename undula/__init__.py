"""Signal features, grouped evaluation and reports as Spark DataFrame jobs."""
