"""Operators on panels: DataFrame in, DataFrame out."""
