"""Windowed taxi-trip analytics on PySpark, for batch and streaming DataFrames."""
