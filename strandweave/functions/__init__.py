"""Column expressions: sequences, k-mers, evolutionary formulas."""
