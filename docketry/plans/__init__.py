"""Queries of the operators over the given tables, each with its DuckDB twin where SQL can say it."""
