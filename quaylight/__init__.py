"""Spark-first analytics over message streams, feeds and personal time series."""
