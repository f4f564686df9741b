"""Explainable geometry on large measurement tables, as PySpark DataFrame operators."""
