"""What several operators share: cut lineage, word patterns, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestframe.storage import Scratch, new_path as new_path

#: A word is a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder, so that lost executors cost no recomputation."""
    return Scratch(df.sparkSession).keep(df, "cut")


def word_count(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds), F.lit(0)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def draw(df: DataFrame, seed: str, key: str, rows: int, total: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``rows`` rows, the first by a hash of ``key``: the same whenever they are drawn.

    Rows are first kept or not by their hash alone, so that all tasks together pass on about twice as
    many, whatever the input's size. ``total`` is the number of rows, counted where it isn't given."""
    total = df.count() if total is None else total
    h = F.xxhash64(F.lit(seed), key)
    low = F.pmod(h, F.lit(1 << 40))
    # Twice the rows and a margin, so that too few are drawn hardly ever; then they are fewer.
    share = 1.0 if total <= 2 * rows + 100 else (2 * rows + 100) / total
    return df.filter(low <= int(share * (1 << 40))).orderBy(low, *ties).limit(rows)
