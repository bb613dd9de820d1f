"""Column expressions: DataFrame columns in, a Column out, no action."""
