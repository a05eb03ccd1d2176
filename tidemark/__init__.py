"""A Spark-native engine for declarative stream and batch SQL scripts."""
