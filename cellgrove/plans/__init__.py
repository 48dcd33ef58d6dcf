"""The catalogue of queries and their DuckDB statements."""
