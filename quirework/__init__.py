"""Spark-native processing and quality engine for scientific documents."""
