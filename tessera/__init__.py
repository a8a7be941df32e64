"""Spark-native preparation, scoring, curation and evaluation of training data."""
