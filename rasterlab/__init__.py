"""Raster screening and small-sample evaluation on Spark DataFrames."""
