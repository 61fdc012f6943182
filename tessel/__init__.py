"""tessel: a Spark-native retrieval-analytics engine."""
