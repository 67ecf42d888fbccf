"""A Spark-native engine for memory, retrieval and training-data workloads."""
