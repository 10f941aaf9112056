"""Column functions: native expressions, and Arrow UDFs where Spark has no builtin."""
