"""Column -> Column expressions. Everything is a built-in Spark expression except
HTML entity decoding, the one vectorised (Arrow) UDF."""
