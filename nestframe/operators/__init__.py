"""Nested selection, relationships and batched lookups as DataFrame plans."""
