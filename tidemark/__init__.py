"""Spark-first analytics over time-evolving semi-structured data."""
