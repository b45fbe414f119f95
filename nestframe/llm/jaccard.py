"""N-gram Jaccard join by count vectors in an R-tree.

A set's shingles are hashed into groups; the counts by group are a point. Two sets overlap in no more
than the summed coordinate minima of their points, so pairs are bounded before any set is looked at.

* Sets that are equal are one node, known by a 128-bit digest of the whole set (of its words, if it is small).
* Points meet by shared keys: sets that link differ in at most d shingles, a number that follows from their
  sizes, so of more than d parts into which all shingles fall by hash, one at least is the same in both. A part's
  content is the key. Keys that hold the same nodes are one. Passages that many documents share seldom fill a part.
* Within a key a bulk-loaded R-tree over the points is joined with itself from the root down: a pair of boxes goes on
  while the summed minima of their upper corners, and their sizes, allow a link; finer counts bound what is
  left. Keys with very many nodes are split into blocks that meet pairwise.
* Pairs that are left are verified on their words.
* A first round keeps a spanning forest of each key's possible pairs and verifies it. A
  second round takes the possible pairs that are still in different components, so no link between
  components is lost and a group of many near copies costs little more than its size.
"""

from __future__ import annotations

import hashlib
import secrets
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestframe.llm.common import read
from nestframe.llm.graph import components
from nestframe.llm.shingles import BASE, mix64, shingle_sets, word_sets
from nestframe.storage import Scratch

#: Coordinates of a point, and of its finer counts.
GROUPS, FINE = 32, 256
#: Groups of the counts that bound a pair once more before its words meet.
FINEST = 1024
#: Bits of the node filter that is sent to tasks: so many a node, up to a bound of 64 MB.
BITS_A_NODE, MOST_BITS = 16, 1 << 29
#: A task remembers so many nodes, so as not to pass on their copies.
COPIES = 1 << 18
#: Sets of up to so many shingles are known by their words, larger ones by their hashed shingles.
SMALL = 64
#: Sizes are dealt into intervals that grow by this factor; a set may have this share more parts than it needs.
GROWTH, SPARE = 1.5, 0.06
#: Points of a leaf, boxes of pairs bounded at once, and nodes of a block of a large key.
LEAF, PAIRS, BLOCK = 16, 4096, 20_000


def _rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _node(s: np.ndarray, text: str, k: int) -> bytes:
    """A set's digest."""
    if len(s) > SMALL:
        return hashlib.blake2b(s.tobytes(), digest_size=16, person=b"hashes").digest()
    return hashlib.blake2b(b"\n".join(sorted(b" ".join(x) for x in word_sets(text, k))), digest_size=16, person=b"words").digest()


def tag(node: str) -> Column:
    """A node's 64 bits by which keys know it; nodes that share one meet all the same."""
    return F.xxhash64(node)


def intervals(percent: int) -> list[tuple[int, int, int, int]]:
    """(low, high, parts, spare) of size intervals: sets that link, the larger in the interval, differ in
    parts - spare - 1 shingles at most.

    Intervals grow by more than 100 / percent, so the smaller set is in the same interval or the one before."""
    growth, low, out = max(GROWTH, 105 / percent), 1, []
    while low < 1 << 40:
        high = max(low, int(low * growth))
        d = 2 * high * (100 - percent) // (100 + percent)
        spare = int((d + 1) * SPARE) + 1
        out.append((low, high, d + 1 + spare if d else 0, spare))
        low = high + 1
    return out


def part_keys(s: np.ndarray, percent: int, known: list[tuple[int, int, int, int]]) -> np.ndarray:
    """A set's keys, for its own interval and, where it may link to sets of the next, for that too.

    A set of n shingles differs from any that it links to in n (100 - percent) / percent at most, so the first parts
    of that number, one and the spare ones are enough; the larger set has more of them. Equal parts may be equal in
    being empty. A set with fewer empty ones than are to spare shares a part that isn't with every set it
    links to; only sets with more have their empty parts as keys."""
    n, hashed, out = len(s), mix64(s + BASE), []
    own = next(i for i, x in enumerate(known) if n <= x[1])
    for i in (own, own + 1) if 100 * n >= percent * known[own + 1][0] else (own,):
        _, _, parts, spare = known[i]
        used = min(parts, n * (100 - percent) // percent + 1 + spare) if parts else 0
        if used > spare + 1:
            part = (hashed % np.uint64(parts)).astype(np.int64)
            content = np.zeros(parts, np.uint64)
            np.add.at(content, part, hashed)
            full = np.bincount(part, minlength=parts)[:used] > 0
            keys = mix64(mix64(content[:used]) + np.arange(used, dtype=np.uint64) * BASE + np.uint64(i))
            out.append(keys if used - full.sum() > spare else keys[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def counts(s: np.ndarray, groups: int = FINE) -> bytes:
    """Shingles by group, a byte each, or four where a byte is too small."""
    c = np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups)
    return c.astype(np.uint8 if c.max(initial=0) < 256 else np.uint32).tobytes()


def counted(raw: bytes, groups: int = FINE) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == groups else np.uint32)


def shingled(docs: DataFrame, k: int, percent: int, secret: int) -> DataFrame:
    """doc_id, n (set size), node (null: empty set) of every row, and of a node, once a task at least, its point (counts by fine group) and keys, null in other rows."""
    known = intervals(percent)

    def run(batches):
        seen: set[bytes] = set()
        for part in _rows(batches):
            texts = part.column("text").to_pylist()
            sizes, nodes, points, keys = [], [], [], []
            for text, s in zip(texts, shingle_sets(texts, k, secret), strict=True):
                node = _node(s, text, k) if len(s) else None
                new = node is not None and node not in seen
                if new:
                    if len(seen) >= COPIES:
                        seen = set()
                    seen.add(node)
                sizes.append(len(s))
                nodes.append(node)
                points.append(counts(s) if new else None)
                keys.append(part_keys(s, percent, known).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(points, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "point", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, node binary, point binary, keys array<long>")


class Tree:
    """A bulk-loaded R-tree: points are halved along their widest coordinate until a leaf holds them.

    Node i holds the points ``rows[i]``; its box's upper corner is ``high[i]``, its sizes lie from ``low_n[i]`` to ``high_n[i]``, and
    its children are ``left[i]`` and ``right[i]``, -1 in a leaf."""

    def __init__(self, x: np.ndarray, n: np.ndarray) -> None:
        self.rows, self.left, self.right, depth = [np.arange(len(x))], [-1], [-1], [0]
        at = 0
        while at < len(self.rows):
            part = self.rows[at]
            if len(part) > LEAF:
                of = x[part]
                axis = int(np.argmax(of.max(0) - of.min(0)))
                part = part[np.argsort(of[:, axis], kind="stable")]
                self.left[at], self.right[at] = len(self.rows), len(self.rows) + 1
                self.rows += [part[: len(part) // 2], part[len(part) // 2 :]]
                self.left += [-1, -1]
                self.right += [-1, -1]
                depth += [depth[at] + 1] * 2
            at += 1
        self.depth = np.array(depth)
        self.high = np.array([x[p].max(0) for p in self.rows])
        self.low_n, self.high_n = (np.array([f(n[p]) for p in self.rows]) for f in (np.min, np.max))
        self.size = np.array([len(p) for p in self.rows])
        self.left, self.right = np.array(self.left), np.array(self.right)

    def joined(self, percent: int, cuts: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves, each pair once, whose boxes allow a link; ``cuts`` counts pairs of points by (depth, whether they go on)."""
        todo = [np.zeros((1, 2), np.int64)]
        while todo:
            pairs = todo.pop()
            i, j = pairs.T
            on = np.minimum(self.high[i], self.high[j]).sum(1) * (100 + percent) >= percent * (self.low_n[i] + self.low_n[j])
            on &= (100 * self.high_n[i] >= percent * self.low_n[j]) & (100 * self.high_n[j] >= percent * self.low_n[i])
            if cuts is not None:
                for d, go, m in zip(np.maximum(self.depth[i], self.depth[j]).tolist(), on.tolist(), np.where(i == j, self.size[i] * (self.size[i] - 1) // 2, self.size[i] * self.size[j]).tolist(), strict=True):
                    cuts[d, go] += m
            i, j = i[on], j[on]
            ends = (self.left[i] < 0) & (self.left[j] < 0)
            for a, b in zip(i[ends].tolist(), j[ends].tolist(), strict=True):
                yield self.rows[a], self.rows[b]
            i, j = i[~ends], j[~ends]
            one, two = i == j, i != j
            # The larger of two different boxes is opened; a leaf is never larger than a node that isn't one.
            first = self.size[i] >= self.size[j]
            big, small = np.where(first, i, j)[two], np.where(first, j, i)[two]
            left, right = self.left[i[one]], self.right[i[one]]
            more = np.concatenate([np.column_stack(p) for p in ((left, left), (left, right), (right, right), (self.left[big], small), (self.right[big], small))])
            todo += [more[at : at + PAIRS] for at in range(0, len(more), PAIRS)]


def possible(fine: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of pairs to look at, as two index arrays, a mask of pairs that may link, and their bounds.

    ``side`` is 0 or 1: where both occur, only pairs across are looked at. What the tree leaves is bounded
    by the points, then by the finer counts.
    """
    x = fine.reshape(len(fine), GROUPS, -1).sum(2)
    across = bool(side.any() and not side.all())
    for a, b in Tree(x, n).joined(percent):
        shared = np.minimum(x[a][:, None, :], x[b][None, :, :]).sum(2)
        ok = shared * (100 + percent) >= percent * (n[a][:, None] + n[b][None, :])
        if a is b:
            ok &= np.triu(np.ones_like(ok), 1)
        if across:
            ok &= side[a][:, None] != side[b][None, :]
        r, c = np.nonzero(ok)
        if len(r):
            shared = np.zeros(ok.shape)
            shared[r, c] = closer = np.minimum(fine[a[r]], fine[b[c]]).sum(1)
            ok[r, c] = closer * (100 + percent) >= percent * (n[a[r]] + n[b[c]])
            if ok.any():
                yield a, b, ok, shared / (n[a][:, None] + n[b][None, :])


def forest(x: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that may link, nearest first within each pair of leaves."""
    label = np.arange(len(x))
    out_a: list[int] = []
    out_b: list[int] = []
    for a, b, ok, near in possible(x, n, side, percent):
        near = np.where(ok, near, -1.0)
        while True:
            near[label[a][:, None] == label[b][None, :]] = -1.0
            best = int(near.argmax())
            i, j = divmod(best, len(b))
            if near[i, j] < 0:
                break
            out_a.append(int(a[i]))
            out_b.append(int(b[j]))
            label[label == label[b[j]]] = label[a[i]]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def rest(x: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs that may link across components."""
    for a, b, ok, _ in possible(x, n, side, percent):
        i, j = np.nonzero(ok & (label[a][:, None] != label[b][None, :]))
        yield a[i], b[j]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal (key, i, j) of batches sorted by them; a run may go over batches."""
    kept: list[pa.RecordBatch] = []
    ident = lambda b, r: tuple(b.column(c)[r].as_py() for c in ("key", "i", "j"))
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")])
        at = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = batch.slice(a, b - a)
            if kept and ident(kept[0], 0) != ident(part, 0):
                yield _columns(kept)
                kept = []
            kept.append(part)
    if kept:
        yield _columns(kept)


def _columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(parts)
    out = {c: table[c].to_numpy() for c in table.column_names if c not in ("point", "component")}
    out["x"] = np.array([counted(p) for p in table["point"].to_pylist()]).astype(np.int32)
    if "component" in table.column_names:
        numbers: dict[bytes, int] = {}
        out["component"] = np.array([numbers.setdefault(c, len(numbers)) for c in table["component"].to_pylist()])
    return out


def candidates(members: DataFrame, percent: int, labelled: bool) -> DataFrame:
    """Distinct pairs (a, b) of nodes to verify; ``members``: key, node, n, point, nodes (how many the key has) and, in the second round, component."""
    blocks = F.ceil(F.col("nodes") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "nodes")
    dealt = dealt.withColumn("side", (F.col("own") == F.col("j")).cast("int")).drop("own")

    def run(batches):
        held: list[tuple[bytes, bytes]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([p[i] for p in held], pa.binary()) for i in (0, 1)], names=["a", "b"])
        for g in _groups(batches):
            node = g["node"]
            side = g["side"] if g["i"][0] != g["j"][0] else np.zeros(len(node), np.int64)
            if len(node) < 2:
                continue
            if labelled:
                pairs = rest(g["x"], g["n"], side, percent, g["component"])
            else:
                pairs = [forest(g["x"], g["n"], side, percent)]
            for a, b in pairs:
                held += [(p, q) if p < q else (q, p) for p, q in zip(node[a].tolist(), node[b].tolist(), strict=True)]
                if len(held) > 50_000:
                    yield pack()
                    held = []
        if held:
            yield pack()

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return ordered.mapInArrow(run, "a binary, b binary").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, k: int, secret: int) -> DataFrame:
    """node, n, finest (counts), text of the given nodes, made anew from the texts.

    A bit filter of bounded size, sent to the tasks, spares most other texts the way to the exact semi join."""
    bits = 1 << min(MOST_BITS, max(1 << 16, BITS_A_NODE * nodes.count())).bit_length() - 1
    hashed = nodes.select(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1)).alias("h"))
    table = hashed.groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.int64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches):
        known = sent.value
        seen: set[bytes] = set()
        for part in _rows(batches):
            texts = part.column("text").to_pylist()
            out: list[tuple[bytes, int, bytes, str]] = []
            for text, s in zip(texts, shingle_sets(texts, k, secret), strict=True):
                if not len(s):
                    continue
                node = _node(s, text, k)
                h = int.from_bytes(node[:4]) & (bits - 1)
                if node not in seen and int(known[h >> 6]) >> (h & 63) & 1:
                    if len(seen) >= COPIES:
                        seen = set()
                    seen.add(node)
                    out.append((node, len(s), counts(s, FINEST), text))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["node", "n", "finest", "text"])

    made = docs.select("text").mapInArrow(run, "node binary, n long, finest binary, text string")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def close(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that the finest counts allow; these are much smaller than the texts."""

    def run(batches):
        for part in _rows(batches):
            keep = [int(np.minimum(counted(p, FINEST), counted(q, FINEST)).sum(dtype=np.int64)) * (100 + percent) >= percent * (m + n) for p, q, m, n in zip(*(part.column(c).to_pylist() for c in ("ca", "cb", "na", "nb")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    finest = texts.select("node", "n", "finest")
    both = pairs.join(finest.toDF("a", "na", "ca"), "a").join(finest.toDF("b", "nb", "cb"), "b")
    return both.select("a", "b", "na", "ca", "nb", "cb").mapInArrow(run, "a binary, b binary")


def verified(scratch: Scratch, docs: DataFrame, pairs: DataFrame, k: int, percent: int, secret: int) -> DataFrame:
    """The pairs whose sets link, by their words."""
    nodes = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = scratch.keep(texts_of(docs, nodes, k, secret), "texts")
    left = scratch.keep(close(pairs, texts, percent), "close")

    def run(batches):
        for part in _rows(batches, 64):
            keep = []
            last, one = None, set()
            for a, p, q in zip(part.column("a").to_pylist(), part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True):
                if a != last:
                    last, one = a, word_sets(p, k)
                other = word_sets(q, k)
                shared = len(one & other)
                keep.append(100 * shared >= percent * (len(one) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    text = texts.select("node", "text")
    both = left.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")
    edges = scratch.keep(both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"), "edges")
    scratch.drop(nodes, texts, left)
    return edges


def members(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """key, tag (of a node), nodes (how many nodes the key has) of keys that more than one node has."""
    rows = sets.filter(F.col("keys").isNotNull()).select(tag("node").alias("tag"), F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).filter("lo < hi").select("key")
    shared = scratch.keep(shared, "shared")  # so that its shuffle is gone when the rows are shuffled again
    member = scratch.keep(rows.join(shared, "key").distinct(), "members")
    # Near copies share most of their keys: of keys with the same nodes (by two hashes) one is kept.
    alike = member.groupBy("key").agg(F.count("*").alias("nodes"), *(F.bit_xor(F.xxhash64(F.lit(i), "tag")).alias(f"h{i}") for i in (0, 1)))
    kept = alike.groupBy("nodes", "h0", "h1").agg(F.min("key").alias("key")).select("key", "nodes")
    out = scratch.keep(member.join(kept, "key"), "keys")
    scratch.drop(shared, member)
    return out


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Sets of distinct k-word shingles (A-Z lower-cased) link when 100 times their intersection is at
    least ``percent`` times their union. component_id is the smallest doc_id reachable by links. A text
    of fewer than k words is one shingle; null texts and texts without words have no shingles and are
    alone. Equal sets are linked, so are rows that repeat a doc_id with equal texts. A null doc_id takes part, and is a
    component_id only where all of a component are null. An empty table gives an empty result. Other
    columns are not looked at. Pairs are looked for by hashes under a key that is drawn anew for each call, and
    verified on their words; equal sets are known by 128-bit digests.
    """
    docs = docs.select("doc_id", "text")
    scratch, secret = Scratch(docs.sparkSession), secrets.randbits(64)
    made = scratch.keep(shingled(docs, k, percent, secret), "sets")
    rows = made.filter("n > 0").select("doc_id", "n", "node")
    member = members(scratch, made)
    seen = member.select("tag").distinct()
    point = made.filter(F.col("point").isNotNull()).select(tag("node").alias("tag"), "node", "n", "point").join(seen, "tag", "left_semi").dropDuplicates(["node"])
    full = scratch.keep(member.join(point, "tag").drop("tag"), "full")
    scratch.drop(member)
    first = scratch.keep(candidates(full, percent, False), "first")
    edges = verified(scratch, docs, first, k, percent, secret)
    known = components(scratch, edges)
    # Keys of two nodes are done; the others' pairs across components are still to be verified.
    labelled = full.filter("nodes > 2").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    second = scratch.keep(candidates(labelled.join(open_keys, "key", "left_semi"), percent, True).join(first, ["a", "b"], "left_anti"), "second")
    if not second.isEmpty():
        added = verified(scratch, docs, second, k, percent, secret)
        if not added.isEmpty():
            known = components(scratch, edges.unionByName(added))
    scratch.drop(full, first, second)
    # A component's smallest id, by way of its nodes: copies are grouped before components are.
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component_id")
    alone = made.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"), k=3, percent=90)
