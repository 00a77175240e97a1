"""Column expressions and the ordered-scan helpers."""
