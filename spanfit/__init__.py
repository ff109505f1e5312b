"""Spatial-fit and catalog analytics on PySpark DataFrames."""
