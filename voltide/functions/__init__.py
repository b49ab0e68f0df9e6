"""Column functions: text, numbers, normal law, pricing formulas, formats."""
