"""Joins and aggregations: pairs, meats, serial terms, the covariance itself."""
