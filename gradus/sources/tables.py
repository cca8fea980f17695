"""Reading the standard tables, and changes of stored tables by key.

Changes are functions from tables to tables; `stored` writes a result in place of the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace what a partitioned table holds for the keys in `df`; other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write `df` in place of the table at `path`, which it may be made from, and read it again.

    The new table is whole before the old one goes; a failure between leaves it under its own name,
    and a reader in between finds none: tables that are read meanwhile are for `replace_partitions`.
    """
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs.delete(at(path), True)
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"{fresh} could not take the place of {path}")
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of `new`, the first by `order` of those with equal keys, and rows of `old` whose key
    `new` lacks.  Columns that one lacks are null; rows of `old` without a key stay."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    return old.join(first, key, "left_anti").unionByName(first, allowMissingColumns=True)


def patched(old: DataFrame, changes: DataFrame, key: str, given: str = "given") -> DataFrame:
    """`old` with the fields that `changes` (one row a key) names in its array `given`; null is a
    value like any other, and keys that `old` lacks are ignored."""
    fields = [x for x in changes.columns if x in old.columns and x != key]
    c = changes.select(F.col(key), F.col(given).alias("__given"), *(F.col(x).alias(f"__{x}") for x in fields))
    wide = old.join(c, key, "left")
    value = lambda x: F.when(F.array_contains("__given", x), F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in fields else F.col(x)
    return wide.select(*map(value, old.columns))


def without(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of `old` whose key is not in `gone`; rows without a key stay."""
    return old.join(gone.select(key).distinct(), key, "left_anti")


def cascaded(gone: DataFrame, key: str, parents: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of a table and of those that refer to it by the same key, once `gone` is deleted."""
    return {"": without(parents, gone, key)} | {name: without(child, gone, key) for name, child in children.items()}


def found_or_created(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """name, id, created for each name: that of the catalogue (name, id) entry equal but for case,
    the smallest of several; else a new id, a hash of the name in lower case."""
    known = catalogue.groupBy(F.lower(F.trim("name")).alias("__k")).agg(F.min("id").alias("id"))
    k = F.lower(F.trim("name"))
    j = names.select("name", k.alias("__k")).join(known, "__k", "left")
    return j.select("name", F.coalesce("id", F.xxhash64("__k")).alias("id"), F.col("id").isNull().alias("created"))
