"""The extended SQL dialect, rewritten to Spark SQL and DataFrame operators."""
