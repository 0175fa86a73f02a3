"""Column functions: strict parsing, formatting, text tests."""
