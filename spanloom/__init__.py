"""Annotated-text analytics as composable Spark operators."""
