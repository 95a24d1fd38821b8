"""Spark-native processing of captured web content and text corpora."""
