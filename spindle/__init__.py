"""spindle: a Spark-first SQL and data-processing engine."""
