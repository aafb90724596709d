"""A Spark-native full-text search and link-analysis engine."""
