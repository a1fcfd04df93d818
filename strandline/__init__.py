"""Spark-native analytics over collections of short sequence reads."""
