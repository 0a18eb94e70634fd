"""Spatial-HAC covariance estimation on Spark."""
