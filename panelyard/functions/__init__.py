"""Panel formulas."""
