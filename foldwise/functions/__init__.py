"""Column-level functions built from Spark built-ins."""
