"""Quillon: hierarchical item codes and next-item analytics on Spark DataFrames."""
