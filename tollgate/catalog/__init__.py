"""Registered queries over the given tables, with a DuckDB statement for each where SQL can say it."""
