"""Column-level building blocks: rules, marker formulas and fixed values."""
