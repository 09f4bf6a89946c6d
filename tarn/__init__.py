"""Spark-native analytics over compiled application packages and the tasks that process them."""
