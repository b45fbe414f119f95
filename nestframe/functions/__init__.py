"""Coercions of columns and of arguments."""
