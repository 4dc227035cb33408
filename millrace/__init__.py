"""Spark-native analytics: typed lookups, search, sorts, 32-bit expressions, keyed state, grids and rasters."""
