"""Scalar functions as Column expressions, with Arrow UDFs where Spark has no equivalent."""
