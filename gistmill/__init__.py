"""A Spark-native engine for mining needs from discussion-style text."""
