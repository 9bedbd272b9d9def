"""Rating, ranking and recommendation analytics on Spark."""
