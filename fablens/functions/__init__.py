"""Column functions: every function takes and returns Columns and stays inside generated JVM code."""
