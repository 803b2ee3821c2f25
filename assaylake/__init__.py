"""Spark-first analytics over structured evaluation runs."""
