"""Name-resolution analytics and corpus preparation on Spark."""
