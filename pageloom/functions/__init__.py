"""Column functions. All are built-in Spark expressions."""
