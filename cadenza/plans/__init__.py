"""SQL twins of the queries."""
