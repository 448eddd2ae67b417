"""DuckDB statements that compute each registered query a second way."""
