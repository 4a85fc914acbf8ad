"""A Spark-native engine for evaluating repeated runs of the same work items."""
