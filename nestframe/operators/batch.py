"""Batched keyed lookups: distinct keys meet a loader's rows once, primed rows and errors take precedence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Load = Callable[[DataFrame], DataFrame]
#: Fixed value: the message of a lookup without a key.
MISSING = "must specify key to identify data to be loaded"


def in_batches(call: Callable[[pd.Series], pd.DataFrame], key: str, schema: str, size: int) -> Load:
    """A loader by a function that gets up to ``size`` keys at a time and gives rows with ``key``; tasks call it, in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                yield call(batch[key].iloc[at : at + size].reset_index(drop=True))

    return lambda keys: keys.select(key).mapInPandas(run, schema)


class Lookup:
    """A keyed loader. ``load`` gets distinct non-null keys (column ``key``) and gives rows with ``key``.

    Primed rows and errors stand in for loaded rows; what is primed first for a key stays. ``known_as`` tells keys apart: keys
    that it makes equal are one, of which the smallest is loaded. Nothing runs until the result is used."""

    def __init__(self, load: Load, key: str, known_as: Callable[[Column], Column] = lambda c: c) -> None:
        self.load, self.key, self.known_as = load, key, known_as
        self.primed: DataFrame | None = None
        self.failed: DataFrame | None = None

    def _same(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__known", self.known_as(F.col(self.key)))

    def _new(self, rows: DataFrame) -> DataFrame:
        """Rows of keys that nothing is primed for, one a key."""
        rows = self._same(rows).dropDuplicates(["__known"])
        for there in (self.primed, self.failed):
            if there is not None:
                rows = rows.join(there.select("__known"), "__known", "left_anti")
        return rows

    def prime(self, rows: DataFrame) -> Lookup:
        new = self._new(rows)
        self.primed = new if self.primed is None else self.primed.unionByName(new)
        return self

    def prime_error(self, rows: DataFrame) -> Lookup:
        """Keys (with a column ``message``) whose lookup fails."""
        new = self._new(rows.select(self.key, "message"))
        self.failed = new if self.failed is None else self.failed.unionByName(new)
        return self

    def clear(self, keys: DataFrame | None = None) -> Lookup:
        """Forgets what is primed: of the given keys, or all."""
        left = lambda there: None if there is None or keys is None else there.join(self._same(keys.select(self.key)).select("__known"), "__known", "left_anti")
        self.primed, self.failed = left(self.primed), left(self.failed)
        return self

    def _got(self, keys: DataFrame) -> DataFrame:
        """Rows of the distinct keys, with ``__known``."""
        wanted = self._same(keys.select(self.key).filter(F.col(self.key).isNotNull())).groupBy("__known").agg(F.min(self.key).alias(self.key))
        missing = wanted
        for there in (self.primed, self.failed):
            if there is not None:
                missing = missing.join(there.select("__known"), "__known", "left_anti")
        loaded = self._same(self.load(missing.select(self.key)))
        return loaded if self.primed is None else self.primed.join(wanted.select("__known"), "__known", "left_semi").unionByName(loaded)

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the distinct keys; keys that no row has, and those that fail, are left out."""
        return self._got(keys).drop("__known")

    def many(self, rows: DataFrame, name: str = "found", error: str | None = None) -> DataFrame:
        """Each row with what its key finds, as a struct, null for null keys and keys that no row has.

        ``error`` names a column for the message of a key that fails or is null."""
        found = self._got(rows)
        out = self._same(rows).join(found.select("__known", F.struct(*[c for c in found.columns if c not in (self.key, "__known")]).alias(name)), "__known", "left")
        if error is not None:
            message = F.when(F.col(self.key).isNull(), F.lit(MISSING))
            if self.failed is not None:
                out = out.join(self.failed.select("__known", F.col("message").alias("__message")), "__known", "left")
                message = F.coalesce(message, F.col("__message"))
            out = out.withColumn(error, message).drop("__message")
        return out.drop("__known")
