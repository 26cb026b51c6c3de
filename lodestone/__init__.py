"""Lodestone: evidence retrieval, fusion and evaluation as composable Spark DataFrame transforms."""
