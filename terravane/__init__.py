"""Geospatial data fusion and line-of-sight analytics on Spark DataFrames."""
