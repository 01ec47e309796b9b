"""Functions that the dialect has and Spark SQL lacks, as Column functions and as SQL text."""
