"""Relational operators over experiment tables (joins, aggregates, windows)."""
