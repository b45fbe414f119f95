"""What the plans of the vector operators read: blocks that bounds pass over, leaves that searches visit, queries whose ids repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestframe.llm import ann, topk
from nestframe.llm.vectors import blocked, celled, packed, usable


@pytest.fixture(scope="module")
def clusters(spark):
    """Forty clusters of two hundred vectors, whose segments differ by cluster."""
    rng = np.random.default_rng(3)
    centre = np.repeat(rng.normal(size=(40, 8)), 4, axis=1)
    x = np.repeat(centre, 200, axis=0) + 0.05 * rng.normal(size=(8000, 32))
    order = rng.permutation(8000)
    return x[order], spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x[order])], "vec_id long, embedding array<double>")


def brute(x, i, k, score):
    s = score(x, x[i])
    return [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:k]


def test_blocks_are_passed_over(clusters, monkeypatch):
    x, df = clusters
    sent, real = [], topk.routed
    monkeypatch.setattr(topk, "routed", lambda *a: sent.append(real(*a)) or sent[-1])
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=250).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    whole = np.floor(256 * x)
    assert all(got[i] == brute(whole, i, 5, lambda m, q: m @ q) for i in range(0, 8000, 50))
    pairs = sent[0].select(F.sum(F.length("ids") / 8)).first()[0]
    blocks = sent[0].select("block").distinct().count()
    assert pairs < 0.35 * 160 * blocks


def test_queries_visit_few_leaves_of_clusters(clusters):
    x, df = clusters
    got, scanned = {}, []
    vectors = usable(df, zero=False)
    index = ann.Index(ann.grow(vectors), {})
    rows = celled(vectors, lambda m: index.cells(m))
    asked = ann._queries(rows.filter(F.col("vec_id") % 50 == 0))
    index.widths = ann.calibrate(rows, asked, index, 5, ann.RECALL)
    sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    for i in range(0, 8000, 50):
        scanned.append(sum(sizes.get(c, 0) for c, _ in index.visit(x[i])) / len(x))
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    hits = sum(len(got[i] & set(brute(unit, i, 5, lambda m, q: m @ q))) for i in range(0, 8000, 50))
    assert hits >= 0.9 * 5 * 160 and np.mean(scanned) < 0.15


def test_blocks_hold_every_row_once(clusters):
    _, df = clusters
    rows = celled(usable(df), lambda m: (m[:, 0] > 0).astype(int) * 3 + (m[:, 4] > 0.5) * 1)
    for size in (100, 3000, 10**6):
        parts, layout = blocked(rows, "vec_id", size)
        blocks = packed(parts, "dim", "block").select(F.length("ids").alias("n"), "block").collect()
        assert sum(r["n"] for r in blocks) == 8 * 8000 and len(blocks) == layout.count(32)
        assert {b for c in layout.by_dim[32] for b in layout.blocks(32, c)} == {r["block"] for r in blocks}


def test_copies_of_a_query_that_share_its_id(spark):
    rows = [(0, [1.0, 0.0])] * 9 + [(i, [1.0, 0.0]) for i in (60, 61)] + [(70, [0.9, 0.1]), (71, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.search(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [60, 61, 70]


def test_a_very_long_vector_changes_nothing_for_others(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)] + [(1000, rng.normal(size=200_000).tolist())]
    trees = ann.grow(usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert trees[16].leaves > 1 and 200_000 not in trees
