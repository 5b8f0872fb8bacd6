"""Scalar column expressions. Everything here is native Spark, no Python UDF."""
