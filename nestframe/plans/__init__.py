"""Checks of selections and catalogs of schemas, as joins and groupings."""
