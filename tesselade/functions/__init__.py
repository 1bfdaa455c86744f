"""Column builders and the few Arrow UDFs."""
