"""Operators over logs, lists and metrics: DataFrame in, DataFrame out."""
