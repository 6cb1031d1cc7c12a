"""Operators on paragraph tables."""
