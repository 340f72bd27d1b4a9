"""Relational operators over the operation log."""
