"""Column functions: each takes and returns ``Column``; no UDF among them."""
