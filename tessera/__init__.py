"""Spark-first document and evidence analytics: composable DataFrame operators."""
