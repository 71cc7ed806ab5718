"""Whole analyses, sessions and the registry of queries."""
