"""Spark-first tabular analytics and design-search engine."""
