"""Operators: one function per operation, DataFrame in, DataFrame out."""
