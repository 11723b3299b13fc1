"""Column-to-column helpers built on native Spark expressions."""
