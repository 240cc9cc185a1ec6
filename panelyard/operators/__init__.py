"""Operators on panels, cross-sections and series."""
