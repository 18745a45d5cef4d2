"""Column -> Column expressions (URL, text)."""
