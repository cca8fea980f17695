"""Chains of named stages over rows, with what each took, changed and set aside."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Stage(NamedTuple):
    """What a stage makes of a value; why it fails (null: it does not), from the value before and
    after; and what is odd about what it gives, without failing (null or empty: nothing)."""

    name: str
    change: Callable[[Column], Column]
    reason: Callable[[Column, Column], Column] = lambda before, after: F.lit(None).cast("string")
    odd: Callable[[Column], Column] = lambda after: F.lit(None).cast("string")


RECORD = "struct<stage:string,taken:boolean,changed:boolean,reason:string,odd:string>"


def staged(df: DataFrame, column: str, stages: list[Stage]) -> DataFrame:
    """`df` with `column` as the stages leave it, and `trace`, a record for each stage.

    A row that fails keeps the value it failed with, and later stages do not take it.  Nulls are
    values like any other: a stage says itself whether they fail.  Each stage's value is computed
    once, as a row of a generator.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    out = df.select(*others, F.struct(F.col(column).alias("v"), F.lit(True).alias("ok"), F.array().cast(f"array<{RECORD}>").alias("t")).alias("__s"))
    for s in stages:
        before, ok = F.col("__s.v"), F.col("__s.ok")
        after = F.when(ok, s.change(before)).otherwise(before)
        out = out.select(*others, "__s", F.explode(F.array(F.struct(after.alias("v")))).alias("__a"))
        after = F.col("__a.v")
        reason = F.when(ok, s.reason(before, after))
        record = F.struct(F.lit(s.name).alias("stage"), ok.alias("taken"), (ok & ~before.eqNullSafe(after)).alias("changed"), reason.alias("reason"), F.when(ok & reason.isNull(), F.nullif(s.odd(after), F.lit(""))).alias("odd"))
        state = F.struct(F.when(reason.isNull(), after).otherwise(before).alias("v"), F.lit(True).alias("ok"), record.alias("r"), F.col("__s.t").alias("t"))
        out = out.select(*others, F.explode(F.array(state)).alias("__n"))
        out = out.select(*others, F.struct(F.col("__n.v").alias("v"), (F.col("__n.r.taken") & F.col("__n.r.reason").isNull()).alias("ok"), F.concat("__n.t", F.array("__n.r")).alias("t")).alias("__s"))
    return out.select(*others, F.col("__s.v").alias(column), F.col("__s.t").alias("trace"))


def failed(df: DataFrame) -> Column:
    """stage and reason of a staged row's failure; null for good ones."""
    bad = F.filter("trace", lambda r: r["reason"].isNotNull())
    return F.when(F.size(bad) > 0, F.struct(F.get(bad, 0)["stage"].alias("stage"), F.get(bad, 0)["reason"].alias("reason")))


def watched(df: DataFrame, stages: list[Stage]) -> tuple[DataFrame, dict[str, Observation]]:
    """A staged table with an observation for each stage: taken, passed, changed, degraded.

    They are filled by the first action on the returned table, in the same pass."""
    seen = {}
    for i, s in enumerate(stages):
        seen[s.name] = Observation(f"stage {i} {s.name}")
        r = F.get("trace", i)
        counts = {"taken": r["taken"], "passed": r["taken"] & r["reason"].isNull(), "changed": r["changed"], "degraded": r["odd"].isNotNull()}
        df = df.observe(seen[s.name], *(F.count_if(c).alias(n) for n, c in counts.items()))
    return df, seen


def counts(df: DataFrame) -> DataFrame:
    """The same counts as rows: place, stage, taken, passed, changed, degraded."""
    r = df.select(F.posexplode("trace").alias("place", "r"))
    c = {"taken": F.col("r.taken"), "passed": F.col("r.taken") & F.col("r.reason").isNull(), "changed": F.col("r.changed"), "degraded": F.col("r.odd").isNotNull()}
    return r.groupBy("place", F.col("r.stage").alias("stage")).agg(*(F.count_if(x).alias(n) for n, x in c.items()))
