"""Memory analytics on Spark: records, hybrid retrieval, lifecycle and evaluation as DataFrame operations."""
