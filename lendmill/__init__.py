"""Spark-native credit decisioning and document analytics."""
