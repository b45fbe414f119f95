"""Selections over streams: plain fields only, as nested lists would have to be kept as state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from nestframe.operators.nest import Edge, ObjectType, Pick, Schema, SelectionError, Selector


def subscribe(schema: Schema, type_: str, stream: DataFrame, *picks: Pick, variables: Mapping | None = None) -> DataFrame:
    """The selection of a stream of the type's rows, as a stream; to-one edges join the static child."""
    owner = schema.types[type_]
    selector = Selector(schema, variables)
    for p in selector.collect(type_, picks).values():
        f = owner.fields.get(p.name)
        if isinstance(f, Edge) and (f.many or f.keys):
            raise SelectionError(f"Field {p.name!r} is a list and can't be selected from a stream")
    bound = Schema({**schema.types, type_: ObjectType(owner.name, lambda: stream, owner.fields, owner.interfaces, owner.key)})
    return Selector(bound, variables).rows(type_, *picks)
