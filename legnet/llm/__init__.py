"""Operators for preparing training data: one module per operator."""
