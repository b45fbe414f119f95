"""Exact top-k by inner product with multi-resolution segment statistics.

A vector's segments have means and deviations. For two vectors the products of their means (times the
segment's length) plus the products of their deviations bound the inner product from above, that is, the distance from
below; more segments bound it closer. Blocks of near vectors have ranges of these statistics. A first pass over each query's own
block gives a score that its k-th best can't fall below; a query is sent only to the blocks whose ranges at 4 and 16 segments can
reach it, pairs of vectors that can't at 4 and 16 segments are passed over there, and the rest are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestframe.llm.ann import Index, grow
from nestframe.llm.common import read
from nestframe.llm.vectors import BLOCK, QUERY_BLOCK, best, blocked, celled, meet, packed, unpack, usable
from nestframe.storage import Scratch

#: Segments by resolution.
COARSE, FINE = 4, 16
#: Blocks' ranges that are looked at together.
HEADS = 4096


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose products sum to the bound: each segment's mean times the root of its length, then its deviation's norm."""
    at = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
    means = [p.mean(1, keepdims=True) for p in parts]
    return np.hstack([*(m * np.sqrt(p.shape[1]) for m, p in zip(means, parts, strict=True)), *(np.sqrt(((p - m) ** 2).sum(1, keepdims=True)) for m, p in zip(means, parts, strict=True))]) if parts else np.zeros((len(x), 1))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with rows; beyond 64 bits they stay at its ends."""
    largest = (np.abs(q).max(initial=0)) * (np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if largest < 2**53:
        return (q @ c.T).astype(np.int64)
    if largest < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T
    return np.array([[max(-(2**63), min(2**63 - 1, int(v))) for v in r] for r in whole], np.int64)


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of this block's best k that reach ``least`` (minus infinity: all)."""
    levels = [(statistics(q, s), statistics(c, s)) for s in (COARSE, FINE) if s < q.shape[1]]
    slack = 1e-9 * (1 + np.sqrt((q * q).sum(1))) * (1 + np.sqrt((c * c).sum(1)).max(initial=0))
    for start in range(0, len(qid), 128):
        rows = slice(start, start + 128)
        alive = np.ones((len(qid[rows]), len(cid)), bool)
        for of_q, of_c in levels:
            if alive.mean() < 0.05:
                break
            alive &= of_q[rows] @ of_c.T >= (least[rows] - slack[rows])[:, None]
        used = np.flatnonzero(alive.any(0))
        if not len(used):
            continue
        scores = _exact(q[rows], c[used])
        alive = alive[:, used] & (cid[used][None, :] != qid[rows][:, None]) & (scores >= least[rows][:, None])
        for i in range(len(scores)):
            hit = np.flatnonzero(alive[i])
            if len(hit) > k:
                s = scores[i, hit]
                kth = np.partition(s, len(s) - k)[len(s) - k]
                hit = hit[s >= kth]
            order = np.lexsort((cid[used[hit]], ~scores[i, hit]))[:k]
            hit = hit[order]
            if len(hit):
                yield start + i, cid[used[hit]], scores[i, hit]


def ranges(x: np.ndarray) -> list[np.ndarray]:
    """A block's lowest and highest means and largest deviations by segment, at each resolution."""
    out = []
    for segments in (COARSE, FINE):
        s = statistics(x, segments)
        n = s.shape[1] // 2
        out += [s[:, :n].min(0), s[:, :n].max(0), s[:, n:].max(0)]
    return out


def heads(blocks: DataFrame, groups: int) -> DataFrame:
    """dim, head (which group), list (of block and its ranges): all blocks of a dimension in ``groups`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.concatenate(ranges(unpack(r["ids"], r["matrix"], r["dim"])[1])).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("block"), pa.array(found, pa.binary())], names=["dim", "block", "ranges"])

    every = blocks.select("dim", "block", "ids", "matrix").mapInArrow(run, "dim int, block int, ranges binary")
    return every.groupBy("dim", F.pmod("block", F.lit(groups)).alias("head")).agg(F.collect_list(F.struct("block", "ranges")).alias("list"))


def reached(q: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries with blocks, by ``ranges`` in rows; the closest of the resolutions."""
    out, at = np.full((len(q), len(every)), np.inf), 0
    for segments in (COARSE, FINE):
        s = statistics(q, segments)
        n = s.shape[1] // 2
        low, high, dev = (every[:, at + k * n : at + (k + 1) * n] for k in range(3))
        at += 3 * n
        out = np.minimum(out, np.maximum(s[:, :n], 0) @ high.T + np.minimum(s[:, :n], 0) @ low.T + s[:, n:] @ dev.T)
    return out


def routed(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """dim, block, ids, matrix, extra (scores to reach): the queries of each row that a block may answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids, q = unpack(r["ids"], r["matrix"], r["dim"])
                least = np.frombuffer(r["extra"], np.float64)
                bound = reached(q, np.array([np.frombuffer(h["ranges"], np.float64) for h in r["list"]]).reshape(len(r["list"]), -1)) if r["dim"] else np.zeros((len(ids), len(r["list"])))
                use = bound + np.abs(bound) * 1e-9 + 1e-6 >= least[:, None]
                for h, column in zip(r["list"], use.T, strict=True):
                    if column.any():
                        yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([h["block"]], pa.int32()), *(pa.array([x[column].tobytes()], pa.binary()) for x in (ids, q, least))], names=["dim", "block", "ids", "matrix", "extra"])

    return queries.join(lists, ["dim", "head"]).select("dim", "ids", "matrix", "extra", "list").mapInArrow(run, "dim int, block int, ids binary, matrix binary, extra binary")


def top_k(embeddings: DataFrame, is_query, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` the k largest inner products of floor(256 x).

    All other rows of the same dimension are candidates (all are given where there are fewer than k);
    ties go to the smaller vec_id. Rows that share the query's vec_id are its own and never candidates;
    of query rows that repeat a vec_id one is kept; candidate rows that repeat count each. Null ids, null vectors and vectors with
    null or non-finite components take no part; empty vectors score 0 with each other. Scores beyond 64
    bits stay at its ends. An empty table gives an empty result. Other columns are not looked at. Vectors are dealt into blocks by a
    tree that is fitted on a bounded sample; that bears on time alone.
    """
    scratch = Scratch(embeddings.sparkSession)
    vectors = usable(embeddings)
    index = Index(grow(vectors, rows_a_leaf=block // 8), {})
    sent = embeddings.sparkSession.sparkContext.broadcast(index)
    rows = scratch.keep(celled(vectors, lambda x: sent.value.cells(x), quantised), "rows")
    parts, layout = blocked(rows, "vec_id", block)
    blocks = scratch.keep(packed(parts, "dim", "block"), "blocks")
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "x", "cell")).alias("v")).select("vec_id", "v.dim", "v.cell", "v.x")
    # Queries are packed by their own block, where a first search gives each a score to reach.
    home, _ = blocked(asked, "vec_id", query_block)
    own = F.create_map(*[x for d, c in layout.first for x in (F.lit(f"{d}:{c}"), F.lit(layout.first[d, c]))]) if layout.first else F.create_map(F.lit(""), F.lit(0))
    queries = packed(home.withColumnRenamed("block", "part").withColumn("block", F.element_at(own, F.concat_ws(":", "dim", "cell"))), "dim", "block", "part").withColumn("extra", F.lit(None).cast("binary"))

    def first(here: dict, row: dict) -> pa.RecordBatch:
        least = np.full(len(row["ids"]), -np.inf)
        for i, _, scores in search(row["ids"], row["matrix"], here["ids"], here["matrix"], least.copy(), k):
            if len(scores) == k:
                least[i] = scores[-1]
        return pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (row["ids"], row["matrix"], least))], names=["dim", "ids", "matrix", "extra"])

    def then(here: dict, row: dict) -> pa.RecordBatch | None:
        found = list(search(row["ids"], row["matrix"], here["ids"], here["matrix"], np.frombuffer(row["extra"], np.float64), k))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(v), row["ids"][i]) for i, v, _ in found])), pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([s for *_, s in found]))], names=["query_id", "vec_id", "score"])

    known = scratch.keep(meet(blocks, queries, first, "dim int, ids binary, matrix binary, extra binary"), "queries")
    groups = max([1, *(-(-layout.count(d) // HEADS) for d in layout.by_dim)])
    spread = known.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return best(meet(blocks, routed(spread, heads(blocks, groups)), then, "query_id long, vec_id long, score long"), k)


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
