"""veilframe: a Spark-native engine for finding, fusing, redacting and auditing sensitive data."""
