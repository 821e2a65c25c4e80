"""Relational operators, each DataFrame to DataFrame."""
