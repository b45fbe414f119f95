"""Tables that jobs write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a new folder of its own; on a cluster that would be another one on every machine, so it is refused."""
    sc = spark.sparkContext
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="nestframe-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/nestframe/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str = "rows", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows, written to the shared folder and read again; filters on the columns ``by`` choose folders."""
    path = new_path(rows.sparkSession, name)
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Scratch:
    """Tables that a job writes on its way: each is cut off from what it was made from, and emptied when it is not needed any more."""

    #: Has Spark delete the shuffle files of a finished write.
    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows from a table of their own, so that lost executors cost no recomputation."""
        path = new_path(self.spark, name)
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            rows.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        self.paths.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Empties kept tables; nothing may read them afterwards."""
        for table, path in self.paths:
            if any(table is t for t in tables):
                table.limit(0).write.mode("overwrite").parquet(path)
        self.paths = [(t, p) for t, p in self.paths if not any(t is x for x in tables)]
