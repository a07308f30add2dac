"""Multiresolution spatial-field analytics, and training-data operators, on Spark DataFrames."""
