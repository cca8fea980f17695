"""Streams with state of their own: stalled jobs that are resumed, and answers merged into a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import settled
from ..sources import tables

#: A job that is resumed so often is given up.
RESUMES = 3


def stalls(events: DataFrame, after: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """user_id, state, resumes: a job without a heartbeat for `after` is resumed, at most RESUMES
    times, and then failed.

    events: user_id, ts.  A row for each change: `alive` at a heartbeat after a stall, `resumed`
    or `failed` when the watermark passes the last heartbeat by `after`.
    """
    wait = int(pd.Timedelta(after).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, resumes, stalled = state.get if state.exists else (0, 0, False)
        out = []
        if state.hasTimedOut:
            resumes, stalled = resumes + 1, True
            out.append((key[0], "resumed" if resumes <= RESUMES else "failed", resumes))
        else:
            newest = max(int(b["ts"].max().timestamp() * 1000) for b in batches)
            if last and not stalled and newest - last > wait:  # the heartbeat came with the stall
                resumes, stalled = resumes + 1, True
                out.append((key[0], "resumed" if resumes <= RESUMES else "failed", resumes))
            if stalled and newest > last:
                out.append((key[0], "alive", resumes))
                stalled = False
            last = max(last, newest)
        state.update((last, resumes, stalled))
        if resumes <= RESUMES and not stalled:
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "state", "resumes"])

    watched = events.withWatermark("ts", late).groupBy("user_id")
    return watched.applyInPandasWithState(step, "user_id bigint, state string, resumes bigint", "last bigint, resumes bigint, stalled boolean", "append", GroupStateTimeout.EventTimeTimeout)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("attempt"), F.lit(buckets)).cast("int").alias("bucket")


def answers_table(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Write a table of answers (attempt, question, and fields) for `merge_answers`: partitioned
    by a hash of attempt."""
    rows.select("*", _bucket(buckets)).write.partitionBy("bucket").parquet(path)


def merge_answers(answers: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Merge a stream of answers into the table at `path` that `answers_table` wrote.

    answers: attempt, question, seq, given (names of the fields that are set), and the fields.
    Each batch changes only the fields that an answer gives, the latest by seq; unknown questions
    are ignored.  A batch reads and replaces the partitions of its own attempts, and no others;
    each takes its place when all are written, so that readers find the old rows or the new ones.
    A batch that runs again changes nothing more.  Returns the started query.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = settled(batch.select("*", _bucket(buckets)))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        if not touched:
            return
        old = batch.sparkSession.read.parquet(path).where(F.col("bucket").isin(touched))
        key = F.concat_ws("/", F.col("attempt").cast("string"), F.col("question").cast("string"))
        fields = [c for c in old.columns if c not in ("attempt", "question", "bucket")]
        value = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains("given", c), F.col("seq")))["v"].alias(c)
        given = F.array_distinct(F.flatten(F.collect_list("given"))).alias("given")
        latest = rows.withColumn("key", key).groupBy("key").agg(given, *map(value, fields))
        new = settled(tables.patched(old.withColumn("key", key), latest, "key").drop("key"))
        tables.replace_partitions(new, path, "bucket")

    return answers.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
