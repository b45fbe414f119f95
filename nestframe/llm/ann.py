"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is indexed in the leaf it descends to. A query walks
the tree with a priority queue of nodes, nearest centre first, and visits leaves until the next node is farther than its first
leaf by more than a width. The width is calibrated: for sampled queries, whose true neighbours are found among all
rows, it is widened until the recall is reached. Neighbouring leaves are kept together in blocks of bounded size; a query is sent
once to each block in which it visits leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestframe.llm.common import draw, read
from nestframe.llm.vectors import BLOCK, best, blocked, celled, meet, packed, usable
from nestframe.storage import Scratch

#: Bounds of what the tree is fitted on and calibrated with.
SAMPLE, CALIBRATION = 20_000, 128
#: Components of a dimension's sampled vectors together: of longer vectors fewer are sampled.
COMPONENTS = 4_000_000
#: Queries that are sent to a block together.
TOGETHER = 256
BRANCHES, LEAF, ROUNDS = 8, 120, 12
#: Dimensions that have trees, the most frequent ones.
DIMENSIONS = 16
RECALL = 0.95


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, as squares of very small or large components leave the range of doubles.
    top = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Tree:
    """Centres by node; a node has children or is a leaf with a number."""

    centres: list[np.ndarray] = field(default_factory=list)  # of a node's children
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, rng: np.random.Generator, most: int = LEAF) -> int:
        me = len(self.leaf)
        self.centres.append(np.zeros((0, x.shape[1])))
        self.children.append([])
        self.leaf.append(-1)
        if len(x) > most:
            centre = x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)]
            for _ in range(ROUNDS):
                own = (x @ centre.T).argmax(1)
                centre = unit(np.array([x[own == k].mean(0) if (own == k).any() else centre[k] for k in range(len(centre))]))
            own = (x @ centre.T).argmax(1)
            used = np.unique(own)
            if len(used) > 1:
                self.centres[me] = centre[used]
                self.children[me] = [self.grow(x[own == k], rng, most) for k in used]
                return me
        self.leaf[me] = self.leaves
        self.leaves += 1
        return me

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of unit vectors."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                own = (x[rows] @ self.centres[node].T).argmax(1)
                todo += [(child, rows[own == k]) for k, child in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, width: float) -> list[tuple[int, float]]:
        """Leaves in the order of best-bin-first search, each with how much farther it or a node on the way to it is than the first one."""
        queue, out, first = [(-np.inf, 0)], [], None
        while queue:
            far, node = heapq.heappop(queue)
            if first is not None and far > first + width:
                break
            if self.leaf[node] >= 0:
                first = far if first is None else first
                out.append((self.leaf[node], 0.0 if far == first else far - first))
            else:
                for d, child in zip((-(self.centres[node] @ q)).tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (max(d, far), child))
        return out


@dataclass
class Index:
    """A tree for each dimension of the sample; rows of other dimensions are all in leaf 0. ``widths`` are by dimension."""

    trees: dict[int, Tree]
    widths: dict[int, float]

    def cells(self, x: np.ndarray) -> np.ndarray:
        tree = self.trees.get(x.shape[1])
        return tree.descend(unit(x)) if tree else np.zeros(len(x), np.int32)

    def visit(self, q: np.ndarray, width: float | None = None) -> list[tuple[int, float]]:
        tree = self.trees.get(len(q))
        return tree.visit(unit(q[None])[0], self.widths.get(len(q), 0.0) if width is None else width) if tree else [(0, 0.0)]


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The cosine of one vector and each of several, computed row by row alike wherever a row stands."""
    return (q * c).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((c * c).sum(1)))


def nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, use: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest rows of a block with other ids, of those that ``use`` (query by row) allows."""
    uq, uc = unit(q), unit(c)
    for start in range(0, len(q), TOGETHER):
        near = uq[start : start + TOGETHER] @ uc.T
        near[qid[start : start + TOGETHER][:, None] == cid[None, :]] = -np.inf
        if use is not None:
            near[~use[start : start + TOGETHER]] = -np.inf
        for i in range(len(near)):
            row = near[i]
            if len(row) > k:
                hit = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9)
            else:
                hit = np.arange(len(row))
            hit = hit[row[hit] > -np.inf]
            score = cosine(q[start + i], c[hit])
            top = np.lexsort((cid[hit], -score))[:k]
            yield start + i, cid[hit[top]], score[top]


def grow(vectors: DataFrame, sample: int = SAMPLE, rows_a_leaf: int | None = None) -> dict[int, Tree]:
    """Trees on up to ``sample`` vectors (fewer if they are long) of each of the usual dimensions, the first by a hash of vec_id, of which equal ones count once.

    ``rows_a_leaf`` makes leaves as large that they hold about so many of all rows. Rare dimensions have no tree: their rows are one leaf."""
    sized = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(DIMENSIONS).collect()
    out = {}
    for d, n in sorted((r["d"], r["count"]) for r in sized):
        if n <= LEAF or d == 0:
            continue
        drawn = draw(vectors.filter(F.size("embedding") == d), "tree", "vec_id", max(LEAF, min(sample, COMPONENTS // d)), n, ties=("embedding",)).select("embedding").toArrow()
        rows = drawn["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        tree = Tree()
        most = LEAF if rows_a_leaf is None else max(LEAF, len(rows) * rows_a_leaf // n)
        tree.grow(np.unique(unit(rows), axis=0), np.random.default_rng(7), most)
        out[d] = tree
    return out


def _queries(rows: DataFrame) -> DataFrame:
    """One row a vec_id."""
    return rows.groupBy("vec_id").agg(F.min(F.struct("dim", "x", "cell")).alias("v")).select("vec_id", "v.dim", "v.cell", "v.x")


def calibrate(rows: DataFrame, asked: DataFrame, index: Index, k: int, recall: float, queries: int = CALIBRATION) -> dict[int, float]:
    """Widths by dimension at which sampled queries find ``recall`` of their true neighbours among all rows.

    The sampled queries (at most ``queries``) go to every task; a task keeps each one's k nearest as it reads its rows, and passes on only these."""
    drawn = draw(asked, "calibration", "vec_id", queries).collect()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["dim"] for r in drawn}:
        of = [r for r in drawn if r["dim"] == d]
        by[d] = (np.array([r["vec_id"] for r in of]), np.array([np.frombuffer(r["x"], np.float64) for r in of]).reshape(len(of), d))
    sent = rows.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[float, int, int]]] = {}
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            for d, (qid, q) in sent.value.items():
                at = np.flatnonzero(dims == d)
                for low in range(0, len(at), 4096):
                    some = at[low : low + 4096]
                    cid = batch.column("vec_id").to_numpy()[some]
                    c = np.array([np.frombuffer(batch.column("x")[int(j)].as_py(), np.float64) for j in some]).reshape(len(some), d)
                    place = dict(zip(cid.tolist(), cells[some].tolist(), strict=True))
                    for i, v, s in nearest(qid, q, cid, c, k):
                        mine = kept.get(int(qid[i]), []) + [(-x, y, place[y]) for x, y in zip(s.tolist(), v.tolist(), strict=True)]
                        kept[int(qid[i])] = sorted(mine)[:k]
        flat = [(i, *x) for i, found in kept.items() for x in found]
        columns = list(zip(*flat, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["query_id", "far", "vec_id", "cell"])

    near = rows.select("vec_id", "dim", "cell", "x").mapInArrow(run, "query_id long, far double, vec_id long, cell int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "vec_id"))
    truth: dict[int, list[int]] = {}
    for r in near.withColumn("rank", rank).filter(F.col("rank") <= k).collect():  # k rows a sampled query
        truth.setdefault(r["query_id"], []).append(r["cell"])
    out = {}
    for d, (qid, q) in by.items():
        needed = []
        for i, v in zip(qid.tolist(), q, strict=True):
            farther = dict(index.visit(v, np.inf))
            needed += [farther[cell] for cell in truth.get(i, [])]
        needed.sort()
        out[d] = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else np.inf
    return out


def search(embeddings: DataFrame, is_query, k: int = 5, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` the k nearest found, by cosine on the original vectors.

    All other rows of the same dimension are indexed and candidates; ties go to the smaller vec_id. Rows that
    share the query's vec_id are its own; of query rows that repeat a vec_id one is kept; candidate rows that repeat count
    each. Null ids, null vectors, zero vectors (empty ones too) and vectors with null or non-finite
    components take no part. A query that finds fewer than k in its leaves is searched in all of them,
    so that all candidates are given where they are fewer than k. An empty table gives an empty
    result. Other columns are not looked at.
    """
    scratch = Scratch(embeddings.sparkSession)
    sc = embeddings.sparkSession.sparkContext
    vectors = usable(embeddings, zero=False)
    index = Index(grow(vectors, sample), {})
    sent = sc.broadcast(index)
    rows = scratch.keep(celled(vectors, lambda x: sent.value.cells(x)), "rows")
    asked = _queries(rows.filter(is_query))
    index.widths = calibrate(rows, asked, index, k, recall)
    parts, layout = blocked(rows, "vec_id", block)
    blocks = scratch.keep(packed(parts, "dim", "block"), "blocks")
    found = meet(blocks, walks(asked, sc.broadcast((index, layout)), k), _within_leaves(k), "query_id long, vec_id long, score double")
    return best(found, k)


def walks(asked: DataFrame, known, k: int) -> DataFrame:
    """dim, block, ids, matrix, extra: queries side by side for each block in which they visit leaves, and which (a mark for each query and leaf of the block's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, layout = known.value
        held: dict[tuple[int, int], list[tuple[int, bytes, bytes]]] = {}

        def pack(key: tuple[int, int]) -> pa.RecordBatch:
            ids, x, cells = zip(*held.pop(key), strict=True)
            extra = np.cumsum([0, *(len(c) // 4 for c in cells)]).astype(np.int64).tobytes() + b"".join(cells)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(x)], pa.binary()), pa.array([extra], pa.binary())], names=["dim", "block", "ids", "matrix", "extra"])

        for batch in batches:
            for r in batch.to_pylist():
                here = layout.by_dim[r["dim"]]
                cells = [c for c, _ in index.visit(np.frombuffer(r["x"], np.float64)) if c in here]
                if sum(here[c] for c in cells) <= k:  # too few, its own row among them
                    cells = list(here)
                by: dict[int, list[int]] = {}
                for c in cells:
                    for b in layout.blocks(r["dim"], c):
                        by.setdefault(b, []).append(c)
                for b, some in by.items():
                    key = (r["dim"], b)
                    held.setdefault(key, []).append((r["vec_id"], r["x"], np.array(some, np.int32).tobytes()))
                    if len(held[key]) >= TOGETHER:
                        yield pack(key)
                if sum(map(len, held.values())) > 64 * TOGETHER:
                    yield from [pack(key) for key in list(held)]
        yield from [pack(key) for key in list(held)]

    return asked.mapInArrow(run, "dim int, block int, ids binary, matrix binary, extra binary")


def _within_leaves(k: int):
    def work(here: dict, row: dict) -> pa.RecordBatch | None:
        n = len(row["ids"])
        at = np.frombuffer(row["extra"][: 8 * (n + 1)], np.int64)
        cells = np.frombuffer(row["extra"][8 * (n + 1) :], np.int32)
        leaves, which = np.unique(here["cells"], return_inverse=True)
        visited = np.zeros((n, len(leaves)), bool)
        for i in range(n):
            visited[i] = np.isin(leaves, cells[at[i] : at[i + 1]])
        rows = np.flatnonzero(visited.any(0)[which])
        found = list(nearest(row["ids"], row["matrix"], here["ids"][rows], here["matrix"][rows], k, visited[:, which[rows]]))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(v), row["ids"][i]) for i, v, _ in found])), pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([s for *_, s in found]))], names=["query_id", "vec_id", "score"])

    return work


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
