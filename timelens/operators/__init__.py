"""Relational operators over the role tables."""
