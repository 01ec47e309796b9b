"""Operators: external commands (udx), text search, and the relational queries over the driver's tables."""
