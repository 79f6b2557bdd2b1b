"""Column expressions and small helpers shared by sources and operators."""
