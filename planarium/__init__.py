"""Spark-native analytics for planar cells, and corpus operators beside it."""
