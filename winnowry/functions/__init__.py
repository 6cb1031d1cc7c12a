"""Scalar functions and the page tree."""
