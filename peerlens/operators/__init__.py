"""Benchmark operators: DataFrame in, DataFrame out."""
