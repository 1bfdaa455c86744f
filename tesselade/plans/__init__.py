"""Named queries with their DuckDB counterparts."""
