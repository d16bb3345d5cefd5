"""Spark-native sensitive-data classification, text scanning and corpus preparation."""
