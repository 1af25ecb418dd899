"""Abundance, yield-curve and corpus analytics on Spark DataFrames."""
