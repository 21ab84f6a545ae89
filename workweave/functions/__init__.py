"""Column functions: everything here returns a Catalyst expression."""
