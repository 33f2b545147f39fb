"""Labelled time series on Spark: subsequence search, shapelet discovery, transforms and classifiers."""
