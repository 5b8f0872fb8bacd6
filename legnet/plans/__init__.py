"""Execution helpers: lineage cuts, skew handling, end-to-end plans."""
