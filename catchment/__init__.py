"""Watershed analytics on Spark: relational helpers, hydrological statistics and network operators."""
