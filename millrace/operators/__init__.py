"""Relational operators and table changes as DataFrame operations."""
