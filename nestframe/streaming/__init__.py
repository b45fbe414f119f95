"""Selections over streams."""
