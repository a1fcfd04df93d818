"""Sources for sequence reads."""
