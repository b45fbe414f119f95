"""Tables that jobs write on their way."""

import os

from nestframe.storage import Scratch, new_path, stored


def size(df):
    paths = {os.path.dirname(f.removeprefix("file://")) for f in df.inputFiles()}
    return sum(os.path.getsize(os.path.join(p, f)) for p in paths for f in os.listdir(p))


def test_dropped_tables_are_empty_and_others_stay(spark):
    scratch = Scratch(spark)
    one, other = (scratch.keep(spark.range(200_000).selectExpr("id", "uuid() AS u"), name) for name in ("one", "other"))
    before = size(one)
    path = next(p for t, p in scratch.paths if t is one)
    scratch.drop(one)
    assert before > 1_000_000 and sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)) < 10_000
    assert other.count() == 200_000 and scratch.paths == [(other, scratch.paths[0][1])]


def test_settings_stay_as_they_were(spark):
    Scratch(spark).keep(spark.range(5), "x")
    assert spark.conf.get(Scratch.CLEANUP, None) is None
    spark.conf.set(Scratch.CLEANUP, "false")
    Scratch(spark).keep(spark.range(5), "x")
    assert spark.conf.get(Scratch.CLEANUP) == "false"
    spark.conf.unset(Scratch.CLEANUP)


def test_stored_rows_and_paths(spark):
    assert stored(spark.range(5).selectExpr("id", "cast(null AS string) AS s")).count() == 5
    assert new_path(spark, "a") != new_path(spark, "a")


def test_stored_rows_are_found_by_folder(spark):
    rows = stored(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "kind string, n int"), "kinds", ("kind",))
    found = rows.filter("kind = 'b'")
    assert sorted(r["n"] for r in found.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(kind" in found._jdf.queryExecution().executedPlan().toString()
