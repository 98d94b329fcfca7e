"""Operators: DataFrame in, DataFrame out. Only model fitting and writing trigger jobs."""
