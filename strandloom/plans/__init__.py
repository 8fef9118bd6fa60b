"""Registered queries and their SQL, by family."""
