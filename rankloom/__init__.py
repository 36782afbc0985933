"""rankloom: Spark-native implicit-feedback ranking analytics."""
