"""A Spark-native analytics engine for wide event tables."""
