"""Column functions: everything here is a plain expression, no Python worker."""
