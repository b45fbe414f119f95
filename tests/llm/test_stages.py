"""Every stage of the pipeline beside a plain version, on rows with nulls, empty and very long texts, ties, repeated ids, and other columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from nestframe.llm import pii, quality
from nestframe.llm.common import new_path
from nestframe.llm.quality import Sizer

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = list(p.COLUMNS)
LONG = "Long texts go on and on, with 12 numbers and me@example.com in them. " * 15_000
GOOD = [f"the quiet river ran under the old bridge in the year of the {w}" for w in ("fox", "hare", "owl", "stag", "crow", "mole") * 5]
BAD = [f"$$$ WIN {w} NOW!!! click >>> {w} <<< $$$" for w in ("cash", "cars", "gold", "trip", "wins", "free") * 5]
ODD = [(1, None, "a"), (1, "", "a"), (None, None, None), (None, "", None), (2, " \t\n", "b"), (3, LONG, "b"), (4, "call +1 (017) 555-7713 or me@example.com", None), (4, "call +1 (017) 555-7713 or me@example.com", None), (None, GOOD[0], "a"), (5, "😀 Ä 日本", "c")]


@pytest.fixture(scope="module")
def rows():
    out = [(100 + i, t, "ab"[i % 2]) for i, t in enumerate(GOOD)] + [(200 + i, t, "b") for i, t in enumerate(BAD)] + ODD
    return [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("row_key", "key", "copy", "times", "time", "taken", "size", "words", "w", "score", "node", "component_id", "label_weight"):
        df = df.withColumn(clash, F.lit(clash))
    return df


@pytest.fixture(scope="module")
def folder(spark):
    path = new_path(spark, "stage-labels")
    spark.createDataFrame([(100 + i, 1) for i in range(len(GOOD))] + [(200 + i, 0) for i in range(len(BAD))], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_empty_tables_stay_empty(spark, docs, folder):
    for name, stage in p.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (out.columns == COLUMNS or name == "tokens")


def test_quality(spark, rows, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.learn(docs, labels.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    size = Sizer(model.pairs)
    expected = Counter(r for r in rows if model.score(__import__("numpy").array([size(r[1] or "")]))[0] >= 0.7)
    got = of(p.quality_stage(spark, docs, folder))
    assert got == expected and any(r[1] in GOOD for r in got) and not any(r[1] in BAD for r in got)


def test_near_duplicates(spark, rows, docs, folder):
    """Texts that are alike but for a word keep one row; texts without words stay each time."""
    from tests.llm.test_brute_force import linked, words

    texts = dict(enumerate(sorted({r[1] for r in rows if r[1] and words(r[1])})))
    group = {texts[i]: root for i, (_, root) in linked(texts, 5, 80).items()}
    expected = Counter(r for r in rows if r[1] not in group)
    best = {}
    for r in rows:
        if r[1] in group:
            k = (r[0] is None, r[0] or 0)
            best[group[r[1]]] = min(best.get(group[r[1]], (k, r)), (k, r), key=lambda x: x[0])
    got = of(p.near_duplicate_stage(spark, docs, folder))
    assert got - expected == Counter(r for _, r in best.values()) and not expected - got


def test_personal_data(spark, rows, docs, folder):
    field = pii.learn(docs)
    every = [x for _, x in pii.found([r[1] for r in rows], field)]
    hidden = [None if r[1] is None else pii.redact(r[1], s) for r, s in zip(rows, every, strict=True)]
    assert of(p.pii_stage(spark, docs, folder)) == Counter((r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in zip(rows, hidden, strict=True))
    assert "call <phone> or <email>" in hidden


def test_mixing(spark, rows, docs, folder):
    got = of(p.mixing_stage(spark, docs, folder))
    many, sizes = Counter(rows), lambda r: len((r[1] or "").split())
    assert set(got) <= set(rows) and all(n <= 3 * many[r] for r, n in got.items()) and all(sizes(r) for r in got)
    total = Counter()
    for r in rows:
        total[r[3]] += sizes(r)
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:  # what is above three times a source goes to the others
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r, n in got.items():
        taken[r[3]] += n * sizes(r)
    longest = {s: max(sizes(r) for r in rows if r[3] == s) for s in sources}
    assert all(target[s] - 1 <= taken[s] <= target[s] + longest[s] + 1 for s in sources)


def test_tokens(spark, rows, docs, folder):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["whole"]) for r in p.token_stage(spark, docs, folder).collect())
    ids = {t: tuple(library.encode(t or "")) for t in {r[1] for r in rows}}
    assert got == Counter((r[0], r[3], len(ids[r[1]]), ids[r[1]], library.decode(list(ids[r[1]])) == (r[1] or "") if ids[r[1]] else not r[1]) for r in rows)
