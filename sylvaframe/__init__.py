"""sylvaframe: Spark-native analytics for distributed random-forest classification."""
