"""Structured Streaming use of the stateless operators."""
