"""Continuous use of the row-wise operators."""
