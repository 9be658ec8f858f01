"""Spark-native curation and evaluation of language-model training data."""
