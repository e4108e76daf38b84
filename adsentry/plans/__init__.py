"""Dimension data: fixed values that queries join with or compile into expressions."""
