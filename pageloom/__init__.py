"""Spark-first engine for layout-parsed documents and question tables."""
