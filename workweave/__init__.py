"""Spark-first analytics for calendar intervals and captured web pages."""
