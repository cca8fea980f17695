"""Stages: rows set aside, observations, repeated failures, nulls."""

from pyspark.sql import functions as F

from gradus.operators import registry
from gradus.plans import stages as S

CHAIN = [
    S.Stage("trim", lambda c: F.trim(c), lambda b, a: F.when(a.isNull(), "null").when(a == "", "empty")),
    S.Stage("half", lambda c: F.substring(c, F.lit(1), (F.length(c) / 2).cast("int")), odd=lambda a: F.when(F.length(a) == 1, "short")),
    S.Stage("upper", F.upper, lambda b, a: F.when(a == "", "nothing left")),
]


def rows(spark):
    return spark.createDataFrame([(1, " abcd "), (2, None), (3, "   "), (4, "a"), (5, "xyz"), (6, "AABB"), (6, "AABB")], "id int, v string")


def test_rows_are_set_aside(spark):
    s = S.staged(rows(spark), "v", CHAIN)
    got = sorted((r.id, r.v, tuple(r.f) if r.f else None) for r in s.select("id", F.col("v"), S.failed(s).alias("f")).fillna("<null>", ["v"]).collect())
    assert got == [(1, "AB", None), (2, "<null>", ("trim", "null")), (3, "   ", ("trim", "empty")), (4, "", ("upper", "nothing left")), (5, "X", None), (6, "AA", None), (6, "AA", None)]
    want = {"trim": (7, 5, 2, 0), "half": (5, 5, 5, 1), "upper": (5, 4, 2, 0)}
    assert {r.stage: (r.taken, r.passed, r.changed, r.degraded) for r in S.counts(s).collect()} == want
    assert S.counts(S.staged(rows(spark).limit(0), "v", CHAIN)).count() == 0


def test_observations_are_the_counts(spark, tmp_path):
    """One write fills the counts of all stages."""
    s, seen = S.watched(S.staged(rows(spark), "v", CHAIN), CHAIN)
    s.write.parquet(str(tmp_path / "out"))
    assert {n: tuple(o.get.values()) for n, o in seen.items()} == {"trim": (7, 5, 2, 0), "half": (5, 5, 5, 1), "upper": (5, 4, 2, 0)}
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_queries_give_python_small_batches(spark, tmp_path, monkeypatch):
    """2,000 pages of 10 kB reach a worker in batches of about 4 MB, not all at once."""
    monkeypatch.setattr(registry, "QUERIES", {})
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(2000).select(F.repeat(F.lit("x"), 10_000).alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"size": [b.nbytes]})

    @registry.query()
    def batch_sizes(t):
        return t("pages").mapInArrow(sizes, "size long")

    got = [r["size"] for r in registry.QUERIES["batch_sizes"](spark, str(tmp_path)).collect()]
    assert sum(got) > 2000 * 10_000 and max(got) < 6e6
