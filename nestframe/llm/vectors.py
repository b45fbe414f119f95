"""Vectors in packed blocks: neighbouring cells' rows make blocks of bounded size that stay where they are, and queries are sent to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: About so many rows make a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 16_384, 1024


def usable(embeddings: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id, embedding of rows with an id and a vector without null or non-finite components (and not all zero unless ``zero``)."""
    limit = F.lit(float("inf"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    if not zero:
        fine &= F.exists("embedding", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).filter(fine)


def celled(vectors: DataFrame, cell: Callable[[np.ndarray], np.ndarray], change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """vec_id, dim, cell, x (float64 in binary): ``cell`` names the cells of a matrix's rows, ``change`` is applied first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                lists = part.column("embedding")
                flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
                dims = np.diff(at)
                ids = part.column("vec_id").to_numpy()
                for d in np.unique(dims):
                    rows = np.flatnonzero(dims == d)
                    x = change(flat[at[rows][:, None] + np.arange(d)].astype(np.float64).reshape(len(rows), d))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), d, np.int32)), pa.array(cell(x).astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "dim", "cell", "x"])

    return vectors.mapInArrow(run, "vec_id long, dim int, cell int, x binary")


@dataclass(frozen=True)
class Layout:
    """Where cells' rows are: by dimension and cell their first block, how many blocks they are dealt over, and their number. As many entries as there are cells."""

    first: dict[tuple[int, int], int]
    parts: dict[tuple[int, int], int]
    rows: dict[tuple[int, int], int]

    def blocks(self, dim: int, cell: int) -> range:
        first = self.first.get((dim, cell), 0)
        return range(first, first + self.parts.get((dim, cell), 0))

    @cached_property
    def by_dim(self) -> dict[int, dict[int, int]]:
        """Each dimension's cells and their numbers of rows."""
        out: dict[int, dict[int, int]] = {}
        for (d, c), n in self.rows.items():
            out.setdefault(d, {})[c] = n
        return out

    def count(self, dim: int) -> int:
        """Blocks of a dimension."""
        return max((f + self.parts[k] for k, f in self.first.items() if k[0] == dim), default=0)


def blocked(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, Layout]:
    """Adds ``block``: cells that follow one another share one as long as it stays near ``size`` rows; a larger cell is dealt over its own ones by a hash of ``key``."""
    counts = sorted((r["dim"], r["cell"], r["count"]) for r in rows.groupBy("dim", "cell").count().collect())
    first, parts, many = {}, {}, {}
    at, held, last = 0, 0, None
    for dim, cell, n in counts:
        if dim != last:
            at, held, last = 0, 0, dim
        if held and held + n > size:
            at, held = at + 1, 0
        first[dim, cell], parts[dim, cell], many[dim, cell] = at, -(-n // size), n
        at, held = (at + parts[dim, cell], 0) if n > size else (at, held + n)
    if not counts:
        return rows.withColumn("block", F.lit(0)), Layout({}, {}, {})
    # The map has an entry a cell; cells are as many as a fitted sample gives leaves.
    place = F.create_map(*[x for k in first for x in (F.lit(f"{k[0]}:{k[1]}"), F.struct(F.lit(first[k]).alias("first"), F.lit(parts[k]).alias("parts")))])
    known = F.element_at(place, F.concat_ws(":", "dim", "cell"))
    return rows.withColumn("block", known["first"] + F.pmod(F.xxhash64(key), known["parts"]).cast("int")), Layout(first, parts, many)


def packed(rows: DataFrame, *by: str) -> DataFrame:
    """One row a group: its cells in order, ids, ascending by cell, and vectors as one matrix, all in binary."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "vec_id", "x"], kind="stable")
        first = pdf.iloc[0]
        return pd.DataFrame({**{c: [first[c]] for c in by}, "cells": [pdf["cell"].to_numpy(np.int32).tobytes()], "ids": [pdf["vec_id"].to_numpy().tobytes()], "matrix": [b"".join(pdf["x"])]})

    return rows.groupBy(*by).applyInPandas(pack, ", ".join(f"{c} int" for c in by) + ", cells binary, ids binary, matrix binary")


def unpack(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(matrix, np.float64).reshape(len(own), dim)


def meet(blocks: DataFrame, queries: DataFrame, work: Callable[[dict, dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` for each block (dim, block, cells, ids, matrix) and each row of queries (dim, block, ids, matrix, extra) that is sent to it.

    Rows are ordered so that a block comes before its queries, which follow one by one: a task holds one block and one row of queries."""
    both = blocks.select("dim", "block", F.lit(0).alias("kind"), "cells", "ids", "matrix", F.lit(None).cast("binary").alias("extra"))
    both = both.unionByName(queries.select("dim", "block", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("cells"), "ids", "matrix", "extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["kind"] == 0:
                    ids, matrix = unpack(row["ids"], row["matrix"], row["dim"])
                    here = {"dim": row["dim"], "block": row["block"], "ids": ids, "matrix": matrix, "cells": np.frombuffer(row["cells"], np.int32)}
                elif (here.get("dim"), here.get("block")) == (row["dim"], row["block"]):
                    row["ids"], row["matrix"] = unpack(row["ids"], row["matrix"], row["dim"])
                    if (out := work(here, row)) is not None:
                        yield out

    return both.repartition("dim", "block").sortWithinPartitions("dim", "block", "kind").mapInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score) rows a query, ties to the smaller vec_id: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
