"""Drift-tolerant tables, document corpora and forecast scoring on PySpark."""
