"""Spark-native analytics engine for image grids, sky catalogues and text corpora."""
