"""Retail fuel price analytics as composable Spark DataFrame operators."""
