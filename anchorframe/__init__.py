"""Genome-anchor analytics as composable Spark DataFrame operators."""
