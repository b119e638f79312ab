"""Column expressions and aggregate recipes."""
