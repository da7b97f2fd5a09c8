"""pagemill: a Spark-native document-analytics engine."""
