"""Logs, queues and stored tables: progress, retries, timers, audit trails, deletes and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from .ranking import best
from .registry import query


@query("""SELECT user_id, event_type, CAST(coalesce(sum(greatest(0, floor(d))), 0) AS BIGINT) AS seconds FROM (SELECT user_id, event_type, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS d FROM events) GROUP BY user_id, event_type""")
def dwell_times(t) -> DataFrame:
    """Whole seconds that users spend at each question, until their next event."""
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = F.floor((F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    e = t("events").select("user_id", "event_type", F.greatest(F.lit(0), seconds).alias("d"), after.isNull().alias("last"))
    return e.groupBy("user_id", "event_type").agg(F.coalesce(F.sum(F.when(~F.col("last"), F.col("d"))), F.lit(0)).cast("bigint").alias("seconds"))


@query("SELECT user_id, count(*) AS entries, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS view, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id")
def audit_fold(t) -> DataFrame:
    """The state that a log of changes leads to: the last value of each field."""
    order = F.struct("ts", "event_id")
    field = lambda name: F.max_by(F.when(F.col("event_type") == name, F.col("value")), F.when(F.col("event_type") == name, order)).alias(name)
    return t("events").groupBy("user_id").agg(F.count("*").alias("entries"), field("click"), field("view"), F.max_by("event_type", order).alias("last"))


@query("""SELECT user_id AS upload_id, arg_max(event_type, (ts, event_id)) AS stage, CAST(arg_max(least(90, 40 + floor(value / 100 * 50 + 0.5e0)), (ts, event_id)) AS BIGINT) AS percent, count(*) AS entries FROM events GROUP BY user_id""")
def upload_progress(t) -> DataFrame:
    """The latest stage of each upload, and its share of the way from 40 to 90 %."""
    order = F.struct("ts", "event_id")
    percent = F.least(F.lit(90), 40 + F.floor(F.col("value") / 100 * 50 + 0.5))
    return t("events").groupBy(F.col("user_id").alias("upload_id")).agg(F.max_by("event_type", order).alias("stage"), F.max_by(percent, order).cast("bigint").alias("percent"), F.count("*").alias("entries"))


@query("""SELECT o_orderkey, attempts, CASE WHEN attempts >= 3 THEN 'skipped' WHEN n = 1 THEN 'next' ELSE 'waiting' END AS state, CAST(400 * pow(2, least(attempts, 2)) AS BIGINT) AS delay_ms
FROM (SELECT o_orderkey, o_custkey % 5 AS attempts, row_number() OVER (PARTITION BY o_custkey % 5 >= 3, o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')""")
def retry_queue(t) -> DataFrame:
    """Open items of each owner: the oldest is tried next, those tried three times are skipped, and
    the wait before a further try doubles."""
    o = t("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_custkey") % 5).alias("attempts"))
    first = best(o.where("attempts < 3"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.lit(True).alias("first"))
    state = F.when(F.col("attempts") >= 3, "skipped").when(F.col("first"), "next").otherwise("waiting")
    return o.join(first, "o_orderkey", "left").select("o_orderkey", "attempts", state.alias("state"), (400 * F.pow(F.lit(2), F.least(F.col("attempts"), F.lit(2)))).cast("bigint").alias("delay_ms"))


@query("""SELECT o_orderkey AS attempt_id, CASE WHEN o_orderstatus <> 'O' THEN 'submitted' WHEN o_orderdate + to_days(CAST(30 + o_custkey % 60 AS INT)) <= TIMESTAMP '2001-01-01' THEN 'auto_submitted' ELSE 'in_progress' END AS status FROM orders""")
def auto_submitted(t) -> DataFrame:
    """Open attempts whose time is over are submitted."""
    due = F.col("o_orderdate") + F.make_dt_interval(days=(30 + F.col("o_custkey") % 60).cast("int"))
    status = F.when(F.col("o_orderstatus") != "O", "submitted").when(due <= F.lit("2001-01-01").cast("timestamp_ntz"), "auto_submitted").otherwise("in_progress")
    return t("orders").select(F.col("o_orderkey").alias("attempt_id"), status.alias("status"))


@query("SELECT conv_id, CAST(max(turn // 3) FILTER (role = 'assistant') AS BIGINT) AS checkpoint, count(*) FILTER (turn // 3 <= c) AS kept, count(*) FILTER (c IS NULL OR turn // 3 > c) AS pruned FROM (SELECT *, max(turn // 3) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS c FROM conversations) GROUP BY conv_id")
def resumed_uploads(t) -> DataFrame:
    """Where each upload goes on: rows up to the last finished batch are kept, later ones go."""
    batch = F.floor(F.col("turn") / 3)
    c = t("conversations").select("conv_id", "turn", batch.alias("batch"), "role")
    done = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("batch").alias("checkpoint"))
    j = c.join(done, "conv_id", "left")
    kept = F.coalesce(F.col("batch") <= F.col("checkpoint"), F.lit(False))
    return j.groupBy("conv_id").agg(F.max("checkpoint").alias("checkpoint"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("pruned"))


@query("""SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_nationkey % 4 <> 1 UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 4 = 1)""")
def cascade_delete(t) -> DataFrame:
    """Rows left of users and of their attempts once some users are deleted."""
    users = t("customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    attempts = t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"))
    left = tables.cascaded(users.where("c_nationkey % 4 = 1"), "user_id", users, {"orders": attempts})
    total = lambda df, name, c: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(c).alias("ids"))
    return total(left[""], "customer", "user_id").union(total(left["orders"], "orders", "id"))


@query("SELECT p_type AS name, c.id IS NULL AS created, c.id AS known FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN (VALUES ('economy', 1), ('Promo', 2), ('PROMO', 3)) AS v(name, id) ON false LEFT JOIN (SELECT lower(name) AS k, min(id)::BIGINT AS id FROM (VALUES ('economy', 1), ('Promo', 2), ('PROMO', 3)) AS w(name, id) GROUP BY 1) c ON c.k = lower(p_type)")
def chapters_found(t) -> DataFrame:
    """Chapters by name but for case; those that are not known are new."""
    parts = t("part").select(F.col("p_type").alias("name")).distinct()
    known = parts.sparkSession.createDataFrame([("economy", 1), ("Promo", 2), ("PROMO", 3)], "name string, id bigint")
    return tables.found_or_created(parts, known).select("name", "created", F.when(~F.col("created"), F.col("id")).alias("known"))


@query("""SELECT c_custkey AS id, CASE WHEN n IS NULL THEN c_acctbal ELSE CAST(n AS DOUBLE) END AS balance FROM customer FULL JOIN (SELECT o_custkey AS k, max(o_orderkey) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey) ON c_custkey = k""")
def upserted(t) -> DataFrame:
    """New rows replace those with equal keys; of several the last one counts."""
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = t("orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("double").alias("balance"))
    return tables.upsert(old, new, "id", [F.desc("balance")])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN -1e0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def patched_rows(t) -> DataFrame:
    """Only the named fields change, to null too; unknown keys are ignored."""
    k = F.col("s_suppkey")
    given = F.array_compact(F.array(F.when(k % 2 == 0, "s_name"), F.when(k % 3 == 0, "s_acctbal")))
    changes = t("supplier").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(-1.0).alias("s_acctbal"), given.alias("given"))
    changes = changes.union(changes.limit(1).select((k + 1_000_000).alias("s_suppkey"), "s_name", "s_acctbal", "given"))
    return tables.patched(t("supplier").select("s_suppkey", "s_name", "s_acctbal"), changes, "s_suppkey")


@query("WITH c AS (SELECT *, max(turn // 3) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS c FROM conversations) SELECT conv_id, turn, role FROM c WHERE turn // 3 <= c")
def pruned_uploads(t) -> DataFrame:
    """What is left of uploads that go on: rows after the last finished batch are deleted, and all
    rows of those without one."""
    c = t("conversations").select("conv_id", "turn", "role", F.floor(F.col("turn") / 3).alias("batch"))
    done = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("batch").alias("checkpoint"))
    return c.join(done, "conv_id").where("batch <= checkpoint").select("conv_id", "turn", "role")
