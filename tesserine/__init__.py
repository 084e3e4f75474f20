"""Tesserine: a Spark-native, LINQ-style analytics engine."""
