"""Training-data operators on Spark.  Nothing outside this package imports it."""
