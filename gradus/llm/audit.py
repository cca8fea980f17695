"""Interaction of filters: every order of them replayed over the documents' failures."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import UPPER, cut, small, space_words, written

#: A: few words, B: repeated words, C: capitals, D: signs, E: the text of a smaller doc_id.
FILTERS = "ABCDE"


def _own(text: Column) -> dict[str, Column]:
    """Failures that a text decides by itself."""
    words = space_words(text)
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: part, failures A to E, and whether a label says good or toxic.

    docs: doc_id, source, text; labels: doc_id, quality, toxic; other columns are ignored.  Null
    texts are empty, null sources the part ''.  E compares whole texts over the table: a row fails
    if a row with a smaller doc_id has its text.  A null doc_id is neither smaller nor larger than
    any, so such rows pass E, and have no labels.  Rows that repeat a doc_id are documents of
    their own.  Any label row of a document counts; null labels count as 0.

    The texts are read once: digests and failures are written, and all joins are on those.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in _own(text).items())))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = rows.join(small(cut(first)), "digest", "left").join(small(cut(said)), "id", "left")
    no = F.lit(False)
    return out.select("part", *"ABCD", F.coalesce(F.col("id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def replay(failed: DataFrame) -> DataFrame:
    """Replay all 120 orders of the filters over `failures`: a row for each part, filter_order, step.

    kept: not removed up to this step; removed: failing this step's filter and none before;
    redundant: failing it, but removed before; unique_fails: failing it only; good_lost and
    toxic_lost: removed here with that label; shapley: the filter's removed over all orders.

    Documents with equal part, failures and labels meet every order alike.  They are first
    counted, with map-side combining, and cross the broadcast orders as one row with their
    number as its weight: what is crossed grows with the number of parts, not of documents.  A
    part of any share of the documents is 128 such rows at most.  No documents give no rows.
    """
    spark = failed.sparkSession
    profiles = failed.groupBy("part", *FILTERS, "good", "toxic").agg(F.count("*").alias("weight"))
    orders = spark.createDataFrame([("".join(p),) for p in permutations(FILTERS)], "filter_order string")
    order, step, weight = F.col("filter_order"), F.col("step"), F.col("weight")
    never = F.lit(len(FILTERS) + 1)
    steps = profiles.crossJoin(F.broadcast(orders))
    steps = steps.withColumn("first", F.least(*(F.when(F.col(k), F.instr(order, k)).otherwise(never) for k in FILTERS)))
    steps = steps.withColumn("n_failed", sum((F.col(k).cast("int") for k in FILTERS), F.lit(0)))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))).withColumn("filter", F.substring(order, step, F.lit(1)))
    fails = F.greatest(*((F.col("filter") == k) & F.col(k) for k in FILTERS))
    here = F.col("first") == step
    count = lambda when, name: F.sum(F.when(when, weight).otherwise(0)).alias(name)
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        count(F.col("first") > step, "kept"),
        count(here, "removed"),
        count(fails & (F.col("first") < step), "redundant"),
        count(fails & (F.col("n_failed") == 1), "unique_fails"),
        count(here & F.col("good"), "good_lost"),
        count(here & F.col("toxic"), "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
