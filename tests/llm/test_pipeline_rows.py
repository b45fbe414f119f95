"""The pipeline's stages on rows with labels, repeated ids and null ids."""

from collections import Counter

import corpus_pipeline as p
from nestframe.llm import mixing
from nestframe.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def labelled(spark, rows):
    path = new_path(spark, "labels-test")
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_good_labels_are_mixed_more_often(spark):
    docs = table(spark, [(i, f"word{i}", "abc"[i % 3]) for i in range(3000)])
    path = labelled(spark, [(i, i // 3 % 2) for i in range(3000)])
    again = Counter(r["doc_id"] // 3 % 2 for r in p.mixing_stage(spark, docs, path).filter("source = 'c'").collect())
    assert again[1] > 1.25 * again[0] > 0


def test_near_duplicates_are_rows(spark):
    same = "one two three four five six seven eight"
    rows = [(1, same, "a"), (1, "quite another text of the same id here", "a"), (None, same, "a"), (None, "a text without an id in two copies", "a"), (None, "a text without an id in two copies", "b"), (2, same, "a"), (2, same, "a"), (3, None, "a"), (3, None, "a"), (None, " ", "a")]
    got = [(r["doc_id"], r["text"]) for r in p.near_duplicate_stage(spark, table(spark, rows), "").collect()]
    assert Counter(got) == Counter({(1, same): 1, (1, rows[1][1]): 1, (None, rows[3][1]): 1, (3, None): 2, (None, " "): 1})


def test_rows_without_an_id_are_mixed_one_by_one(spark):
    docs = table(spark, [(None, f"word{i}", "abc"[i % 3]) for i in range(900)] + [(7, "twice", "c")] * 2)
    got = p.mixing_stage(spark, docs, labelled(spark, [(1, 1)])).collect()
    assert len(got) == 903 and Counter(r["source"] for r in got) == Counter({"a": 564, "b": 226, "c": 113})


def test_a_mix_is_the_same_in_any_number_of_parts(spark):
    """Ids that all rows of a source share, null ids, and weights that differ a thousandfold."""
    rows = [(None if i % 3 else 1, f"s{i % 2}", i % 7, 1000.0 if i % 5 else 1.0, i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long, w double, row_key long")
    of = lambda **more: sorted(map(str, mixing.mix(docs, quality="w", size="words", key="row_key", **more).collect()))
    assert of() == of(bucket_rows=50) == of(bucket_rows=1999)
    assert sum(r["taken"] for r in mixing.mix(docs, size="words", key="row_key", bucket_rows=50).collect()) == sum(r[2] for r in rows)
