"""Readers for survey text formats and stored networks."""
