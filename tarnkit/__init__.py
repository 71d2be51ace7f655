"""Censored-monitoring analytics as Spark DataFrame operators."""
