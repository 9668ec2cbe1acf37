"""Relational operators over the catalogue tables."""
