"""Column functions and small grouped helpers."""
