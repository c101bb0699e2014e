"""Sunstack: Spark-native analytics for bursts of image frames, tables and text corpora."""
