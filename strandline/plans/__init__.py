"""Plans for sequence reads."""
