"""Mergeable sketch analytics for PySpark."""
