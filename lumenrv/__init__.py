"""Precision spectroscopic time series on Spark."""
