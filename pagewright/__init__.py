"""Spark-native analytics over collections of web pages and documents."""
