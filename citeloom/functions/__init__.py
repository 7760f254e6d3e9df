"""Column functions: text, safety rules, redaction and metric formulas."""
