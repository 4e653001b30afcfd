"""kinweave: Spark-native entity clustering over many sources."""
