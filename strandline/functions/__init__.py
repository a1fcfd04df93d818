"""Functions for sequence reads."""
