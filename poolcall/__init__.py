"""Pooled-cell analytics as Spark DataFrame operators."""
