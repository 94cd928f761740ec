"""Column functions: every function takes and returns Spark columns."""
