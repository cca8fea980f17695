"""Mixing sources to target weights by Efraimidis-Spirakis keys and prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, space_words

#: Documents of a bucket of keys, about: what one window of the prefix sum holds.
BUCKET_ROWS = 500


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size and target of sources (source, source_size): a row for each source.

    Sources in code point order, null last, take the weights in turn, repeating.  They share
    `share` times all sizes by weight; none gets over `cap` times its size, and what is over
    goes to the others by weight until none is above.  The order of cap / weight is the order
    in which sources fill up, so one pass of running sums finds the level of the rest.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    everything = Window.partitionBy(F.lit(0))
    s = sources.withColumn("i", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.get(cycle, F.pmod("i", F.lit(len(weights))))).withColumn("cap", cap * F.col("source_size"))
    by_fill = everything.orderBy(F.col("cap") / F.col("weight"), "i")
    filled = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - filled) / rest)
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select("source", "source_size", F.least(F.coalesce(first * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """How many words of each document a mix takes: doc_id, size, source_size, target, taken.

    docs: doc_id, source, text; quality: doc_id, weight (one positive row a document; others
    weigh 1).  A source whose target is e times its size and a rest takes every document e
    times, and fills the rest in the order of the keys -ln(u) / weight, u from a hash of seed
    and doc_id: documents before the budget's end once more, the one at its end in part.
    So no document gives over cap times its size, rounded up, and reruns agree.

    Null and blank texts have size 0 and give nothing.  Null sources are a source.  Ties in
    keys go by doc_id and size; rows that repeat a doc_id are documents of their own.

    Prefix sums run in two steps, sums of key buckets and then rows of a bucket, so that no
    source meets in one task however large it is.
    """
    sized = docs.select("doc_id", "source", F.size(space_words(F.col("text"))).cast("bigint").alias("size"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    weighed = sized.join(quality.select(F.col("doc_id").alias("q_id"), "weight"), F.col("doc_id") == F.col("q_id"), "left").drop("q_id")
    keyed = weighed.withColumn("key", -F.log(u) / F.coalesce("weight", F.lit(1.0))).drop("weight")

    n = docs.select("doc_id").count()
    buckets = max(1, n // BUCKET_ROWS)
    # Under the least weight's distribution no bucket gets more than its share times the ratio of weights.
    least = min(1.0, quality.agg(F.min("weight")).first()[0] or 1.0)
    keyed = keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * least)) * buckets))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    total = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goal = small(targets(total, weights, share, cap)).withColumnRenamed("source", "goal_source")
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b"), before.alias("before"))

    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    out = out.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b")))
    out = out.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    budget = F.round(F.col("target") - epochs * F.col("source_size"))
    extra = F.least(F.greatest(budget - F.col("before") - F.col("inside"), F.lit(0.0)), F.col("size").cast("double"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (epochs * F.col("size") + extra).cast("bigint").alias("taken"))
