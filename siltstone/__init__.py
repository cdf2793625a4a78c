"""Spark-native analytics for code-quality data: reports, regions, graphs, beliefs, vectors and patch search."""
