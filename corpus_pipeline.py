"""The corpus pipeline: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestframe.llm import jaccard, mixing, pii, quality, spm
from nestframe.llm.common import WORD, fold, read
from nestframe.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def row_key() -> Column:
    """128 bits of the SHA-256 of a whole row, its columns told apart by their lengths and nulls by their mark."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in COLUMNS]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labels that op1 learns from.

    Scores go with the texts in one pass; a rejected document goes, all of its copies too, as they score alike. Null texts score as
    empty ones. Without labels of both kinds every row stays or goes by the share of good labels (half without labels). An empty table stays empty; columns
    other than those of documents are dropped."""
    labels = read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2)
    model = quality.learn(docs, labels)
    return quality.accepted(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, Jaccard 0.8; the smallest doc_id stays, a null one last, then the smallest hash of the row.

    Rows that repeat a doc_id, or have none, are told apart by their content. Rows without words (null and empty texts among them) are no duplicates and stay, each
    time they occur. Texts of any length are compared as wholes. An empty table stays empty; columns other than those of documents are dropped."""
    keyed = docs.select(*COLUMNS, row_key().alias("row_key"))
    scratch = Scratch(spark)
    linked = scratch.keep(jaccard.link(keyed.select(F.col("row_key").alias("doc_id"), "text"), k=5, percent=80).filter("n_shingles > 0").select(F.col("doc_id").alias("row_key"), "component_id").distinct(), "linked")
    groups = linked.filter("component_id <> row_key").select("component_id").distinct()
    grouped = linked.join(groups, "component_id", "left_semi").join(keyed.select("row_key", "doc_id").distinct(), "row_key")
    stays = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least")).select("component_id", F.col("least.row_key").alias("kept_key"))
    gone = scratch.keep(grouped.join(stays, "component_id").filter("row_key <> kept_key").select("row_key"), "gone")
    scratch.drop(linked)
    # Equal rows are one group if they have words.
    copy = F.when(F.coalesce(F.col("text").rlike(WORD), F.lit(False)), F.lit(0)).otherwise(1 + F.monotonically_increasing_id())
    return keyed.withColumn("copy", copy).join(gone, "row_key", "left_anti").dropDuplicates(["row_key", "copy"]).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars by the new length.

    Null texts stay null, and so does their n_chars; rows that repeat stay as often. An empty table stays empty; columns other than those of documents are dropped."""
    return pii.redacted(docs.select(*COLUMNS), pii.learn(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes once for each of its epochs, and once more if the rest of its source's budget reaches it.

    Good labels weigh 2, bad ones 1, no label 1.5, as in op10. Documents without words (null and empty texts among them) are no part of a mix. Rows that repeat are
    drawn together and come as often as all of them. A null source is a source. An empty table stays empty; columns other than those of documents are dropped."""
    keyed = docs.select(*COLUMNS, row_key().alias("row_key"))
    sized = mixing.weighed(keyed.select("row_key", "doc_id", "source", mixing.word_count(F.col("text")).alias("words")), read(spark, sf_dir, "labels"))
    # Equal rows have one key; together they come as often as all of them.
    taken = mixing.mix(sized, quality="w", size="words", key="row_key").filter("size > 0").groupBy("row_key").agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("times")).filter("times > 0")
    times = F.sequence(F.lit(1), F.col("times").cast("int"))
    return keyed.dropDuplicates(["row_key"]).join(taken, "row_key").withColumn("time", F.explode(times)).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids: doc_id, source, n_tokens, ids, and ``whole``, whether the ids decode to its text.

    Null and empty texts have no ids and are whole; rows that repeat are encoded each. An empty table gives an empty result."""
    import public_tokenizers

    return spm.encoded(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: No SQL expresses the classifier or the random field; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written as Parquet and read again as the next one's documents, and emptied when that one is done."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
