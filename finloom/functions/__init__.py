"""Column expressions and ordered-set helpers shared by the operators."""
