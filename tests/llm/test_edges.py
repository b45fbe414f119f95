"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from nestframe.llm import ann, jaccard, langid, licenses, mixing, pii, quality, spm, topk, warc
from nestframe.llm.common import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "Hello wide world of very long texts. " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The cat and the dog went over the hill.", "en", "a"), (1, "The cat and the dog went over the hill.", "en", "a"), (2, None, None, None), (3, "", "en", ""), (None, "Der Hund und die Katze", "de", "a"), (4, " \t\n", "de", "b"), (5, LONG, "en", "b"), (6, "mail me@example.com or +1 (017) 555-7713 😀", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("node", "key", "size", "bucket", "part", "cell", "h", "n", "score", "digest", "times", "target"):
        df = df.withColumn(clash, F.lit(clash))
    return df


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.0, 0.0]), (7, [3e38, 1.0]), (None, [1.0, 1.0]), (50, [0.5, 0.5]), (8, [1.0]), (9, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x")).withColumn("part", F.lit(1))


def of(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


def test_quality(docs):
    model = quality.fit([{"text": f"good words of prose number {i}", "quality": 1} for i in range(40)] + [{"text": "###$$$ " * (i % 5 + 3), "quality": 0} for i in range(40)])
    got = of(quality.score(docs, model))
    assert len(got[1]) == 2 and all(0 <= r["score"] <= 1 for rows in got.values() for r in rows)
    assert got[2][0]["score"] == got[3][0]["score"]
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs, quality.fit([])).filter("score <> 0.5").count() == 0
    assert quality.accepted(docs, model).columns == docs.columns


def test_language(docs):
    model = langid.learn(docs)
    got = of(langid.identify(docs, model))
    assert got[1][0]["lang_pred"] == "en" and got[None][0]["lang_pred"] == "de"
    assert got[2][0]["lang_pred"] == got[3][0]["lang_pred"] == got[4][0]["lang_pred"] == "und" and got[2][0]["score"] == 0
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_pii(docs):
    got = of(pii.scan(docs, pii.learn(docs)))
    assert (got[6][0]["n_email"], got[6][0]["n_phone"]) == (1, 1) and got[6][0]["spans"] == "email:5:19,phone:23:40"
    assert got[6][0]["redacted"] == "mail <email> or <phone> 😀"
    assert got[2][0]["spans"] == "" and got[2][0]["redacted"] is None and len(got[1]) == 2
    assert pii.scan(docs.limit(0), pii.fit([])).count() == 0


def test_sentencepiece(docs):
    ids = spm.encode(docs, MODEL)
    got, back = of(ids), of(spm.decode(ids, MODEL))
    assert got[2][0]["ids"] == [] and got[3][0]["ids"] == []
    assert back[5][0]["text"] == LONG and back[4][0]["text"] == " \t\n" and back[6][0]["text"].endswith("😀")
    assert spm.digests(docs.limit(0), MODEL).count() == 0
    assert all(r["whole"] for r in spm.encoded(docs.select("doc_id", "text"), MODEL).collect())


def test_jaccard(docs):
    got = of(jaccard.link(docs, 3, 90))
    assert [r["component_id"] for r in got[1]] == [1, 1]
    assert got[2][0] == {"doc_id": 2, "n_shingles": 0, "component_id": 2} and got[4][0]["component_id"] == 4
    assert got[None][0]["component_id"] is None and got[None][0]["n_shingles"] == 3
    assert jaccard.link(docs.limit(0)).count() == 0


def test_licences(docs):
    spark = docs.sparkSession
    text = "Some words.\r\n  Released under the MIT Licence. \n\nLicensed under CC BY-NC 4.0."
    got = licenses.scan(spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert sorted({(r["license"], text[r["start"] : r["end"]]) for r in got}) == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("MIT", "Released under the MIT Licence.")] and len(got) == 4
    assert licenses.scan(docs).count() == 0


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_warc(spark):
    rows = [(3, "u\r\nX: y", "same"), (2, None, "same"), (2, None, "same"), (5, "w", None), (6, "w", ""), (None, "z", "é"), (7, "l", LONG)]
    path = new_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path)
    got = of(warc.read_archive(spark, path), "page_id")
    assert [r["record_type"] for r in got[2]] == ["response"] * 2 and got[3][0]["record_type"] == "revisit" and got[3][0]["refers_to"] == 2
    assert got[3][0]["url"] == "u%0D%0AX: y" and got[6][0]["refers_to"] == 5 and got[5][0]["payload_bytes"] == 0
    assert got[7][0]["payload_bytes"] == len(LONG) and got[None][0]["payload_bytes"] == 2
    records = of(warc.read_records(spark, path), "page_id")
    assert bytes(records[7][0]["record"]).endswith(LONG.encode() + b"\r\n\r\n") and bytes(records[3][0]["record"]).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    empty = new_path(spark, "warc-empty")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_top_k(vectors):
    got = of(topk.top_k(vectors, F.col("vec_id") % 50 == 0), "query_id")
    assert sorted(got) == [0, 50]
    # vec_id 7 scores beyond 2**63 - 1 and stays there; 1 comes twice, as its rows do.
    assert [(r["rank"], r["vec_id"]) for r in sorted(got[0], key=lambda r: r["rank"])] == [(1, 7), (2, 1), (3, 1), (4, 50), (5, 6)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ann(vectors):
    got = of(ann.search(vectors, F.col("vec_id") % 50 == 0), "query_id")
    assert [r["vec_id"] for r in sorted(got[0], key=lambda r: r["rank"])] == [1, 1, 7, 50]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_warc_copies_and_damage(spark):
    """Many copies of a payload, and one that was changed where it is stored."""
    rows = [(i, f"u{i}", "copy" if i % 3 else f"own {i}") for i in range(300)]
    path = new_path(spark, "warc-copies")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, copies=20)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archive(spark, path, copies=20).collect()}
    assert got == {i: ("response", None, len(t)) if t != "copy" or i == 1 else ("revisit", 1, 4) for i, _, t in rows}
    damaged = new_path(spark, "warc-damaged")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{damaged}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.col("payload") == F.lit(b"own 3"), F.lit(b"OWN 3")).otherwise(F.col("payload"))).write.parquet(f"{damaged}/payloads")
    with pytest.raises(Exception, match="not the one it is kept as"):
        warc.read_archive(spark, damaged).collect()
