"""A Spark-native engine for tenant-aware text memory and hybrid retrieval."""
