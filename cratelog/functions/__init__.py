"""Column functions: tags, text, arithmetic, signals held as arrays, and numeric kernels."""
