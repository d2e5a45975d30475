"""Column expressions: URL, date, text and HTML functions built from Spark's own expressions (no UDF)."""
