"""Operators for sequence reads."""
