"""Mutations: root fields that write run one after the other, each selecting from what is there then; and results as files."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from nestframe.operators.nest import Arg, Pick, Schema, SelectionError, Selector
from nestframe.plans.suggest import did_you_mean
from nestframe.storage import stored


class Versions:
    """A table that is written anew as a whole by every change; frames made of an earlier version stay as they are."""

    def __init__(self, rows: DataFrame, name: str = "versions") -> None:
        self.name = name
        self.rows = stored(rows, name)

    def __call__(self) -> DataFrame:
        return self.rows

    def write(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self.rows = stored(change(self.rows), self.name)


@dataclass(frozen=True)
class Write:
    """A root field that writes. ``apply`` does so for the arguments; ``rows`` are then selected from ``type_name``."""

    type_name: str
    apply: Callable[[Mapping[str, Any]], None]
    where: Callable[[DataFrame, Mapping[str, Any]], DataFrame] | None = None
    args: Mapping[str, Arg] = field(default_factory=dict)


def mutate(schema: Schema, writes: Mapping[str, Write], *picks: Pick, variables: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """The results of root fields by response key, in order: a field's write is done before the next one's begins, and a failure ends the run."""
    selector = Selector(schema, variables)
    out: dict[str, DataFrame] = {}
    for p in picks:
        if not selector.on(p):
            continue
        w = writes.get(p.name)
        if w is None:
            raise SelectionError(f"Cannot query field {p.name!r} on type 'Mutation'.{did_you_mean(p.name, writes)}")
        args = selector.arguments(f"Mutation.{p.name}", w.args, p.args)
        w.apply(args)
        out[p.key] = selector.rows(w.type_name, *p.children, where=(lambda df, w=w, args=args: w.where(df, args)) if w.where else None)
    return out


def write_lines(results: DataFrame, path: str, column: str = "result") -> None:
    """JSON results as lines of text files, written by the tasks that make them."""
    results.select(column).write.text(path)


def read_lines(spark: SparkSession, path: str, column: str = "result") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", column)
