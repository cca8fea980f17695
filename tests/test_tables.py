"""Changes of stored tables."""

from pyspark.sql import functions as F

from gradus.sources import tables


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stored_takes_its_own_place(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(at)
    again = tables.stored(spark.read.parquet(at).where("k = 2"), at)
    assert _rows(again) == [(2, "b")]


def test_replace_partitions(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([("x", 1), ("y", 2)], "v string, k int").write.partitionBy("k").parquet(at)
    tables.replace_partitions(spark.createDataFrame([("z", 2), ("w", 3)], "v string, k int"), at, "k")
    assert _rows(spark.read.parquet(at)) == [("w", 3), ("x", 1), ("z", 2)]


def test_upsert_takes_one_of_equal_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    got = tables.upsert(old, new, "k", [F.desc("seq")]).select("k", "v")
    assert _rows(got) == _rows(spark.createDataFrame([(1, "a"), (2, "d"), (3, "e"), (None, "n")], "k int, v string"))
    assert _rows(tables.upsert(old, new.limit(0), "k", [F.desc("seq")]).select("k", "v")) == _rows(old)


def test_patched_sets_nulls_and_ignores_unknown_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    changes = spark.createDataFrame([(1, None, 5, ["v"]), (9, "x", 9, ["v", "w"])], "k int, v string, w int, given array<string>")
    assert _rows(tables.patched(old, changes, "k")) == [(1, None, 1), (2, "b", 2)]


def test_deletes(spark):
    users = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    attempts = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    left = tables.cascaded(spark.createDataFrame([(2,), (2,)], "k int"), "k", users, {"attempts": attempts})
    assert _rows(left[""]) == [(1,), (None,)] and _rows(left["attempts"]) == [(1, "a")]


def test_found_or_created(spark):
    known = spark.createDataFrame([("Optics", 4), ("optics ", 3)], "name string, id bigint")
    got = {r.name: (r.id, r.created) for r in tables.found_or_created(spark.createDataFrame([("OPTICS",), ("Heat",)], "name string"), known).collect()}
    assert got["OPTICS"] == (3, False) and got["Heat"][1]
