"""Operators over image rows, lines, coefficients and points."""
