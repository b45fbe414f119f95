"""Bindings of tables to typed schemas."""
