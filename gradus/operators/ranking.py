"""Window operators: leaderboards, latest rows, segments and stratified selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def latest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group under an order, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("place") <= n)


def placed_in(rows: DataFrame, group: str, score: str, ties: list[Column]) -> DataFrame:
    """`place` from 1 in each group by falling score, ties by further keys; and `dense`, which equal
    scores share.

    Rows of one score are ordered apart, and the counts of higher scores are added, so that no
    task orders a whole group.
    """
    counts = rows.groupBy(group, score).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dense = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score))).cast("bigint")
    counts = counts.select(F.col(group).alias("__g"), F.col(score).alias("__s"), above.alias("__above"), dense.alias("dense"))
    inside = F.row_number().over(Window.partitionBy(group, score).orderBy(*ties))
    j = rows.withColumn("__inside", inside).join(counts, F.col(group).eqNullSafe(F.col("__g")) & F.col(score).eqNullSafe(F.col("__s")))
    return j.withColumn("place", (F.col("__above") + F.col("__inside")).cast("bigint")).drop("__g", "__s", "__above", "__inside")


_BEST = """SELECT c_nationkey, o_custkey, o_orderkey, CAST(floor(o_totalprice / 10000) AS BIGINT) AS score, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (PARTITION BY c_nationkey, o_custkey ORDER BY floor(o_totalprice / 10000) DESC, o_orderdate, o_orderkey) = 1"""


@query(f"SELECT CAST(c_nationkey AS BIGINT) AS test_id, o_custkey AS user_id, o_orderkey AS attempt_id, score FROM ({_BEST})")
def best_attempt_per_user(t) -> DataFrame:
    return _best(t).select("test_id", "user_id", "attempt_id", "score")


def _best(t) -> DataFrame:
    o = t("orders").where("o_orderstatus <> 'O'").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_nationkey").cast("bigint").alias("test_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("attempt_id"), F.floor(F.col("o_totalprice") / 10000).alias("score"), "o_orderdate")
    return best(o, ["test_id", "user_id"], [F.desc("score"), F.col("o_orderdate"), F.col("attempt_id")])


@query(f"""SELECT CAST(c_nationkey AS BIGINT) AS test_id, o_custkey AS user_id, score, CAST(row_number() OVER w AS BIGINT) AS place, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY score DESC) AS BIGINT) AS dense
FROM ({_BEST}) WINDOW w AS (PARTITION BY c_nationkey ORDER BY score DESC, o_orderdate, o_custkey)""")
def leaderboard(t) -> DataFrame:
    """Places of best attempts in each test: positional, and with equal scores sharing one."""
    placed = placed_in(_best(t), "test_id", "score", [F.col("o_orderdate"), F.col("user_id")])
    return placed.select("test_id", "user_id", "score", "place", "dense")


@query("""SELECT o_custkey AS user_id, count(*) AS attempts, count(*) FILTER (o_orderstatus <> 'O') AS completed, max(o_totalprice) AS best FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5 GROUP BY o_custkey""")
def user_recent(t) -> DataFrame:
    """Summary of each user's latest five attempts."""
    o = latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("attempts"), F.count_if(F.col("o_orderstatus") != "O").alias("completed"), F.max("o_totalprice").alias("best"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def autosave_latest(t) -> DataFrame:
    """Last write wins per user and field."""
    return best(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS attempt_number FROM orders")
def attempt_number(t) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("attempt_number"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS header, CAST(count(*) FILTER (role = 'user') OVER w AS BIGINT) AS segment
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def segment_turns(t) -> DataFrame:
    """Carry each header forward, and number the segments that headers begin."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    is_start = F.col("role") == "user"
    return t("conversations").select("conv_id", "turn", F.last(F.when(is_start, F.col("turn")), ignorenulls=True).over(w).alias("header"), F.sum(is_start.cast("bigint")).over(w).alias("segment"))


@query("""SELECT p_brand AS subject, p_partkey AS question_id, round_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY round_no, p_type) AS BIGINT) AS n FROM
 (SELECT p_brand, p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY md5(CAST(p_partkey AS VARCHAR) || '-7'), p_partkey) AS BIGINT) AS round_no FROM part)) WHERE n <= 12""")
def round_robin_pick(t) -> DataFrame:
    """Twelve questions a subject, taken from its chapters in turn, in a seeded order."""
    p = t("part").select("p_brand", "p_type", "p_partkey", F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-7"))).alias("h"))
    p = p.withColumn("round_no", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("h", "p_partkey")).cast("bigint"))
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("round_no", "p_type"))).where("n <= 12")
    return p.select(F.col("p_brand").alias("subject"), F.col("p_partkey").alias("question_id"), "round_no")


_QUOTA = "CASE d WHEN 'easy' THEN 6 WHEN 'medium' THEN 10 ELSE 4 END"


@query(f"""SELECT p_partkey AS question_id, d AS difficulty FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS n FROM
 (SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 40 THEN 'medium' ELSE 'hard' END AS d FROM part)) WHERE n <= {_QUOTA}""")
def stratified_quota(t) -> DataFrame:
    """A paper of 20: 30 % easy, 50 % medium and the rest hard.  Each stratum is a top-k, so
    that no task sorts a stratum."""
    total = 20
    easy, medium = int(total * 0.3 + 0.5), int(total * 0.5 + 0.5)
    size = F.col("p_size")
    p = t("part").select(F.col("p_partkey").alias("question_id"), F.when(size <= 15, "easy").when(size <= 40, "medium").otherwise("hard").alias("difficulty"), F.md5(F.col("p_partkey").cast("string")).alias("h"))
    out = None
    for name, n in (("easy", easy), ("medium", medium), ("hard", max(0, total - easy - medium))):
        part = p.where(F.col("difficulty") == name).orderBy("h", "question_id").limit(n).select("question_id", "difficulty")
        out = part if out is None else out.union(part)
    return out


@query("SELECT user_id, max(ts) AS last_seen, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS stalled FROM events GROUP BY user_id")
def stall_detect(t) -> DataFrame:
    """Users whose last heartbeat is over a day before the newest one."""
    e = t("events")
    seen = e.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return seen.crossJoin(e.agg(F.max("ts").alias("now"))).select("user_id", "last_seen", (F.col("last_seen") < F.col("now") - F.expr("INTERVAL 1 DAY")).alias("stalled"))
