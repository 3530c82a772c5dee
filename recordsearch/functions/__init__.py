"""Column expressions; none of them runs Python per row."""
