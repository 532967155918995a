"""Spark-native knowledge-catalogue engine."""
