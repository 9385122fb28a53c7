"""Relational operators over norm, pair and review tables."""
