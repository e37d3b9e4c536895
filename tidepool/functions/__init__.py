"""Column functions: everything here takes and returns columns."""
