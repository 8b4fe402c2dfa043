"""Warehouse load operators on Spark: stage, transform, apply, history, mart, surrogate keys."""
