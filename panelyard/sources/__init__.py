"""Panels and observation files."""
