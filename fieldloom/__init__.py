"""Panel data keyed by region and year, as Spark jobs."""
