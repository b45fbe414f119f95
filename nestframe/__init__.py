"""Nested queries over Spark tables: declared selections become whole DataFrame plans."""
