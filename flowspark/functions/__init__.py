"""Column expressions: normalisation rules with no UDFs."""
