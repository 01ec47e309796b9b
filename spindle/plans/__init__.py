"""From statement text to Spark SQL."""
