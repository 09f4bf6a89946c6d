"""Relational operators: joins, aggregates, windows, set operations and verification."""
