"""lumentab: Spark-native analytics over image corpora held as tables."""
