"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only.

A source gives complete epochs of all its documents first; what is left of its target is filled by
documents in the order of exponential keys ``-ln(u) / weight``. ``u`` comes from a digest of the seed,
doc_id and the row's own key, so reruns agree. Rows are ranged by source and key into partitions of bounded size; sums by
(source, partition) place every partition before, across or after the budget's edge, so no source, however
large, is sorted in one task, whatever its ids and weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestframe.llm.common import read, word_count
from nestframe.storage import Scratch

#: About so many documents are sorted together.
BUCKET_ROWS = 200_000


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the md5 of seed and key: 52 bits, the same wherever it is computed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to one row a source (src, src_null, source_size).

    Sources by code point, null last, weigh ``weights`` repeating. All targets together are ``share``
    of all sizes; none is above ``cap`` times its source's size, and what is above goes to the others
    by weight. Ordered by cap / weight the capped sources come first, so the level that the others
    share follows from running sums. The windows without keys hold one row a source.
    """
    ordinal = Window.orderBy("src_null", "src")
    ratio = Window.orderBy("ratio", "src_null", "src")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    whole = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordinal) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("source_weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    capped = capped.withColumn("ratio", F.col("limit") / F.col("source_weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("source_weight").over(every) - F.coalesce(F.sum("source_weight").over(before), F.lit(0.0))
    level = capped.withColumn("level", left / heavy)
    free = F.col("level") < F.col("ratio")
    level = level.withColumn("shared", F.first(F.when(free, F.col("level")), ignorenulls=True).over(whole))
    return level.select("src", "src_null", "source_size", "source_weight", F.when(free, F.col("shared") * F.col("source_weight")).otherwise(F.col("limit")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: str = "mix", quality: str | None = None, size: str | None = None, bucket_rows: int = BUCKET_ROWS, key: str | None = None) -> DataFrame:
    """One row a row of ``docs`` (doc_id, source, and text or a column of sizes named by ``size``): doc_id, source, size, source_size, target, epochs, taken.

    ``taken`` counts words with repeats: ``epochs`` times the size, and the size once more for
    documents within the rest of the target; the document at the edge gives the words that still fit,
    so a source's sum is its target to the nearest word. ``quality`` names a column of positive sampling weights (null or not
    positive: 1). Null or empty texts have size 0 and give nothing. Null sources are one source. Rows
    that repeat count each. ``key`` names a column that tells rows apart: it comes with the result, and rows that
    share a doc_id, or have none, are drawn one by one by it and not all together. An empty table gives an empty result. Other columns are not looked at.
    """
    weight = F.lit(1.0) if quality is None else F.when(F.col(quality) > 0, F.col(quality).cast("double")).otherwise(F.lit(1.0))
    own = [] if key is None else [key]
    drawn = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *[F.concat(F.lit(":"), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in own])
    scratch = Scratch(docs.sparkSession)
    sized = docs.select(*own, "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("src"), F.col("source").isNull().alias("src_null"), (word_count(F.col("text")) if size is None else F.coalesce(F.col(size), F.lit(0)).cast("long")).alias("size"), (-F.log(uniform(drawn, seed)) / weight).alias("es_key"))
    sized = scratch.keep(sized, "sized")
    order = ["es_key", "doc_id", "size", *own]
    buckets = max(1, -(-sized.count() // bucket_rows))
    ranged = scratch.keep(sized.repartitionByRange(buckets, "src_null", "src", *order).withColumn("bucket", F.spark_partition_id()), "ranged")
    scratch.drop(sized)
    parts = scratch.keep(ranged.groupBy("src", "src_null", "bucket").agg(F.sum("size").alias("part")), "parts")
    goal = targets(parts.groupBy("src", "src_null").agg(F.sum("part").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    ahead = Window.partitionBy("src", "src_null").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = parts.withColumn("before", F.coalesce(F.sum("part").over(ahead), F.lit(0))).join(goal, ["src", "src_null"])
    within = Window.partitionBy("src", "src_null", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(edges, ["src", "src_null", "bucket"]).withColumn("room", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room")))
    return placed.select(*own, "doc_id", F.when(~F.col("src_null"), F.col("src")).alias("source"), "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds a sampling weight ``w`` to docs (doc_id and other columns): 1 and the mean of the doc_id's labels, 1.5 without one."""
    weights = labels.groupBy("doc_id").agg((1 + F.avg("quality")).alias("label_weight"))
    return docs.join(weights, "doc_id", "left").withColumn("w", F.coalesce("label_weight", F.lit(1.5)))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents; good labels weigh 2, bad ones 1, no label 1.5. Rows that share a doc_id, or have none, are told apart by their texts."""
    text = F.coalesce(F.md5("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), text.alias("row_key"))
    return mix(weighed(docs, read(spark, sf_dir, "labels")), quality="w", size="words", key="row_key").select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


OP10_SQL = r"""
WITH lab AS (SELECT doc_id, 1 + avg(quality) AS w FROM labels GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(md5(d.text), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(lab.w, 1.5) AS es_key, coalesce(md5(d.text), '') AS row_key
  FROM documents d LEFT JOIN lab USING (doc_id)),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
wt AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM src),
cp AS (SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / w AS ratio FROM wt),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl FROM cp),
tg AS (SELECT source, source_size, CASE WHEN lvl < ratio THEN (SELECT arg_min(lvl, ratio) FROM lv WHERE lvl < ratio) * w ELSE lim END AS target FROM lv),
ep AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM tg),
pl AS (SELECT s.*, e.source_size, e.target, e.epochs, round(e.target)::BIGINT - e.epochs * e.source_size
         - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.es_key, s.doc_id NULLS FIRST, s.size, s.row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
       FROM sized s JOIN ep e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken, source, epochs FROM pl
"""
