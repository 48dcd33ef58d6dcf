"""Column functions: everything stays inside generated code."""
