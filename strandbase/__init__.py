"""A Spark-native engine for byte-exact string columns."""
