"""Column expressions: each function takes columns or names and returns a Column."""
