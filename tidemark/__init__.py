"""Tidemark: time-series segmentation on Spark DataFrames."""
