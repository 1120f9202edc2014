"""Comparative genomics on Spark: plain functions from DataFrames to DataFrames."""
