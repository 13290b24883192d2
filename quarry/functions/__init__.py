"""Column expressions (native Spark functions; Python only where noted)."""
