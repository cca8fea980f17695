"""Lines that many documents hold: levelled sorted runs of line hashes, and what they drop."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dropped, lower_ascii, shared_dir, shuffles_freed, small

#: Documents of a bucket of hashes, about, where there are fewer buckets than shuffle partitions.
BUCKET_DOCS = 50_000
#: White space that is stripped from both ends of a line.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: 128 bits: two lines of a corpus of 10^12 share them with a chance of about 10^-15.
HASH = ["h1", "h2"]


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANK)))


def _hashes(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("line"), c).alias("h2")]


def hashed(docs: DataFrame, least_chars: int = 40, **by: Column) -> DataFrame:
    """Line hashes of a batch: h1, h2, n (documents that hold the key) and last (largest doc_id).

    docs: doc_id, text; other columns are ignored, but for those that `by` names, which group
    as well.  Keys under `least_chars` code points are left out.  Rows that repeat a doc_id are
    documents of their own; a document with a null doc_id counts, and is below any other.
    """
    keys = F.array_distinct(F.filter(F.transform(lines(F.col("text")), key), lambda k: F.char_length(k) >= least_chars))
    each = docs.select(*(c.alias(n) for n, c in by.items()), "doc_id", F.explode(keys).alias("key"))
    return each.select(*by, "doc_id", *_hashes(F.col("key"))).groupBy(*by, *HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


class LineRuns:
    """Line hashes of all batches so far, as levelled sorted runs.

    A run is a table (h1, h2, n, last) in the shared folder, bucketed by hash and sorted inside a
    bucket, so that runs join by merging, without a shuffle.  Each hash lies in one run, that of
    the batch that brought it first; what later batches bring of known hashes goes to runs of
    tallies.  Two runs of a level are merged into one of the next, so that a hash is rewritten
    once a level, and a batch meets one run of each level at most.

    Runs are named in the session's catalogue; `close` removes them and their files.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self._spark = spark
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._name = f"lines_{uuid.uuid4().hex}"
        self._folder = f"{shared_dir(spark)}/{self._name}"
        self._made = 0
        self._known: list[list[str]] = [[]]
        self._tallies: list[list[str]] = [[]]

    def stored(self, rows: DataFrame, *parts: str) -> str:
        """Write rows as a bucketed, sorted table, partitioned by `parts` if any: its name."""
        self._made += 1
        name = f"{self._name}_{self._made}"
        w = rows.write.bucketBy(self._buckets, *HASH).sortBy(*HASH).option("path", f"{self._folder}/{name}")
        with shuffles_freed(self._spark):
            (w.partitionBy(*parts) if parts else w).saveAsTable(name)
        return name

    def _gone(self, names: Iterable[str]) -> None:
        for name in names:
            self._spark.sql(f"DROP TABLE {name}")
            dropped(self._spark, f"{self._folder}/{name}")

    def _merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one, by a merge: numbers add up, the largest doc_id stays."""
        more = self._spark.table(b).select(*HASH, F.col("n").alias("more"), F.col("last").alias("later"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
        return self._spark.table(a).join(more, HASH, "full_outer").select(*HASH, n.alias("n"), F.greatest("last", "later").alias("last"))

    def _push(self, levels: list[list[str]], name: str) -> None:
        """A new run on the lowest level; a level with two is compacted into the next."""
        levels[0].append(name)
        at = 0
        while len(levels[at]) > 1:
            full, levels[at] = levels[at], []
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(self.stored(self._merged(*full)))
            self._gone(full)
            at += 1

    def fresh(self, batch: DataFrame) -> DataFrame:
        """What of a batch (h1, h2, n, last) no run holds: a merge-anti-join with each run.  Read
        it before `add`, which may compact the runs."""
        known = (self._spark.table(n) for level in self._known for n in level)
        return reduce(lambda rows, run: rows.join(run, HASH, "left_anti"), known, batch)

    def add(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, n, last; a hash once): its new hashes are its run, and the others
        go to the tallies.  `batch` is read twice: it should be a table."""
        first = not any(self._known)
        run = self.stored(self.fresh(batch))
        if not first:
            self._push(self._tallies, self.stored(batch.join(self._spark.table(run), HASH, "left_anti")))
        self._push(self._known, run)

    def frequent(self, least: int = 5) -> DataFrame:
        """h1, h2, last of the hashes that `least` documents of all batches hold: each run, merged
        with the tallies."""
        tallies = [n for level in self._tallies for n in level]
        held = self._spark.createDataFrame([], "h1 bigint, h2 bigint, last bigint")
        for run in (n for level in self._known for n in level):
            rows, n, last = self._spark.table(run), F.col("n"), [F.col("last")]
            for i, name in enumerate(tallies):
                rows = rows.join(self._spark.table(name).select(*HASH, F.col("n").alias(f"n{i}"), F.col("last").alias(f"last{i}")), HASH, "left")
                n, last = n + F.coalesce(f"n{i}", F.lit(0)), [*last, F.col(f"last{i}")]
            last = F.greatest(*last) if tallies else last[0]
            held = held.unionByName(rows.where(n >= least).select(*HASH, last.alias("last")))
        return cut(held)

    def close(self) -> None:
        self._gone([n for levels in (self._known, self._tallies) for level in levels for n in level])
        self._known, self._tallies = [[]], [[]]
        dropped(self._spark, self._folder)


def without(docs: DataFrame, frequent: DataFrame, least_chars: int = 40) -> DataFrame:
    """Documents without the lines that `frequent` (h1, h2, last) drops: doc_id, n_lines,
    n_dropped and kept (the other lines, joined by newlines), a row for each row.

    docs: doc_id, text.  A line with a frequent key goes unless its document's doc_id is `last`.
    Places of lines, not lines, are joined and grouped by row, 128 bits of doc_id and text; a group
    is a text's own lines, however often its row repeats.  A null text has one empty line.
    """
    row = [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("row"), "doc_id", "text").alias("r2")]
    keys = F.transform(lines(F.col("text")), key)
    at = docs.select(*row, "doc_id", F.posexplode(F.transform(keys, lambda k: F.when(F.char_length(k) >= least_chars, k)))).where("col is not null")
    at = at.select("r1", "r2", "doc_id", "pos", *_hashes(F.col("col"))).join(small(frequent), HASH)
    gone = at.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))
    out = docs.select("doc_id", "text", *row).join(small(cut(gone)), ["r1", "r2"], "left")

    def rest(all_lines: Column) -> Column:  # a variable of a lambda: it is split once, not for each line
        places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
        return F.array_join(F.transform(places, lambda p: F.get(all_lines, p)), "\n")

    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.get(F.transform(F.array(lines(F.col("text"))), rest), F.lit(0)))
    n = F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1
    return out.select("doc_id", n.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))


def dedup(docs: DataFrame, batches: int = 4, least: int = 5, least_chars: int = 40) -> DataFrame:
    """Drop the lines of a whole table that `least` documents hold, but for the largest doc_id's.

    As `without`, with `frequent` from the table itself, whose documents come as `batches` by a
    hash of doc_id.  All batches are hashed and sorted in one pass over the texts, which combines
    equal lines before it shuffles; then each meets the runs of those before.  There are as many
    buckets as shuffle partitions, or fewer, by the number of documents, down to one a core, so
    that a small table does not become thousands of files.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(most, max(spark.sparkContext.defaultParallelism, docs.count() // BUCKET_DOCS)))
    runs = LineRuns(spark, buckets)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    every = runs.stored(hashed(docs, least_chars, batch=batch).coalesce(buckets), "batch")
    for b in range(batches):
        runs.add(spark.table(every).where(F.col("batch") == b).drop("batch"))
    frequent = runs.frequent(least)
    spark.sql(f"DROP TABLE {every}")
    runs.close()
    return without(docs, frequent, least_chars)
