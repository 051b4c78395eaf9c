"""Spark-native analytics over tiles, rasters, road graphs and their statistics."""
