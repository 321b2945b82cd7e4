"""Column expressions and distributed numeric primitives."""
