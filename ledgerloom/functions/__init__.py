"""Column expressions: no joins, no aggregation."""
