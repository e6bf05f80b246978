"""Scalar building blocks as Columns; none of them needs a UDF."""
