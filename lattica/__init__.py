"""A Spark-native engine for entropy-regularised clustering networks and training-data preparation."""
