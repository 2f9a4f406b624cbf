"""Operators over finance tables."""
