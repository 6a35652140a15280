"""Column expressions (no jobs, no Python UDFs)."""
