"""ranklake: a Spark-native analytics engine for ranked competition results."""
