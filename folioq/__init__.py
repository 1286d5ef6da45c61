"""Spark-first data layer for extracted documents."""
