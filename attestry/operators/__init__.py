"""Operators from DataFrame to DataFrame.

All take their instant of reference (``as_of``) as an argument instead of the
clock, order ties by an explicit key, and keep every row.
"""
