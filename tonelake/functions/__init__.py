"""Column functions: levels, acoustics, text and identity."""
