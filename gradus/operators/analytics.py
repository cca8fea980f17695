"""Aggregations: item analysis, summaries, histograms and totals.

Parts stand for questions, orders for attempts and line items for answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from .registry import query


def finished(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("o_orderstatus").isin("F", "P"))


def outcomes(t) -> DataFrame:
    """Answers of finished attempts: question, outcome and marks."""
    o = finished(t("orders")).select("o_orderkey")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


_ITEMS = """
SELECT p.p_partkey AS question_id, p.p_type AS chapter, count(a.l_partkey) AS attempts,
  count(*) FILTER (a.l_returnflag = 'A') AS correct, count(*) FILTER (a.l_returnflag = 'R') AS wrong,
  count(*) FILTER (a.l_returnflag = 'N') AS skipped, CAST(coalesce(sum(a.l_quantity), 0) AS BIGINT) AS marks_awarded,
  CASE WHEN count(a.l_partkey) = 0 THEN 0 ELSE floor(count(*) FILTER (a.l_returnflag = 'A') * 1000.0 / count(a.l_partkey) + 0.5) / 10 END AS accuracy_pct,
  CASE WHEN count(a.l_partkey) = 0 THEN 0 ELSE floor(sum(a.l_quantity) * 100.0 / count(a.l_partkey) + 0.5) / 100 END AS avg_marks
FROM part p LEFT JOIN (SELECT l.* FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'P')) a ON p.p_partkey = a.l_partkey
GROUP BY p.p_partkey, p.p_type"""


@query(_ITEMS)
def item_analysis(t) -> DataFrame:
    """Attempts, outcomes and marks of each question; answers are added up before the join."""
    flag = F.col("l_returnflag")
    a = outcomes(t).groupBy("l_partkey").agg(F.count("*").alias("attempts"), *(F.count_if(flag == v).alias(k) for k, v in (("correct", "A"), ("wrong", "R"), ("skipped", "N"))), F.sum("l_quantity").alias("marks"))
    p = t("part").select("p_partkey", "p_type").join(a, F.col("p_partkey") == F.col("l_partkey"), "left").na.fill(0)
    n = F.col("attempts")
    avg = F.when(n == 0, 0.0).otherwise(F.floor(F.col("marks") * 100.0 / n + 0.5) / 100)
    return p.select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("chapter"), "attempts", "correct", "wrong", "skipped", F.col("marks").cast("bigint").alias("marks_awarded"), percent(F.col("correct"), n).alias("accuracy_pct"), avg.alias("avg_marks"))


@query(f"SELECT chapter, CAST(sum(wrong) AS BIGINT) AS wrong FROM ({_ITEMS}) GROUP BY chapter ORDER BY wrong DESC, chapter LIMIT 10")
def weak_topics(t) -> DataFrame:
    return item_analysis(t).groupBy("chapter").agg(F.sum("wrong").alias("wrong")).orderBy(F.desc("wrong"), "chapter").limit(10)


@query("SELECT l_linestatus AS kind, count(*) AS n, floor((count(*) - count(*) FILTER (l_returnflag = 'N')) * 1000.0 / count(*) + 0.5) / 10 AS graded_pct FROM lineitem GROUP BY l_linestatus")
def graded_rate(t) -> DataFrame:
    g = t("lineitem").groupBy(F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("skipped"))
    return g.select("kind", "n", percent(F.col("n") - F.col("skipped"), F.col("n")).alias("graded_pct"))


@query("SELECT c_mktsegment AS role, count(*) AS n FROM customer GROUP BY c_mktsegment")
def role_counts(t) -> DataFrame:
    return t("customer").groupBy(F.col("c_mktsegment").alias("role")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY ALL")
def status_type_breakdown(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS active_users,
 (SELECT count(*) FROM part) AS questions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS submitted,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS auto_submitted, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS in_progress""")
def admin_summary(t) -> DataFrame:
    """One wide row of counts; each part is a single row, so that the cross joins are of one row."""
    users = t("customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") >= 0).alias("active_users"))
    questions = t("part").agg(F.count("*").alias("questions"))
    status = F.col("o_orderstatus")
    attempts = t("orders").agg(*(F.count_if(status == v).alias(k) for k, v in (("submitted", "F"), ("auto_submitted", "P"), ("in_progress", "O"))))
    return users.crossJoin(questions).crossJoin(attempts)


@query("""SELECT s_suppkey AS owner_id, count(*) AS answers, count(DISTINCT l_orderkey) AS attempts, floor(avg(l_quantity) * 100 + 0.5) / 100 AS avg_marks
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def owner_activity(t) -> DataFrame:
    a = t("lineitem").select("l_suppkey", "l_orderkey", "l_quantity").join(t("supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return a.groupBy(F.col("s_suppkey").alias("owner_id")).agg(F.count("*").alias("answers"), F.countDistinct("l_orderkey").alias("attempts"), (F.floor(F.avg("l_quantity") * 100 + 0.5) / 100).alias("avg_marks"))


@query("""SELECT CASE WHEN grouping(p_brand) = 0 THEN 'subject' WHEN grouping(p_type) = 0 THEN 'chapter' ELSE 'all' END AS dimension,
 coalesce(p_brand, p_type, '') AS bucket, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())""")
def pool_histograms(t) -> DataFrame:
    """Three histograms in one pass over the pool."""
    p = t("part").groupingSets([[F.col("p_brand")], [F.col("p_type")], []], "p_brand", "p_type").agg(F.count("*").alias("n"), F.grouping("p_brand").alias("gb"), F.grouping("p_type").alias("gt"))
    kind = F.when(F.col("gb") == 0, "subject").when(F.col("gt") == 0, "chapter").otherwise("all")
    return p.select(kind.alias("dimension"), F.coalesce("p_brand", "p_type", F.lit("")).alias("bucket"), "n")


@query("""SELECT l_orderkey AS attempt_id, count(*) AS answers, CAST(sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -1 ELSE 0 END) AS BIGINT) AS score,
 CAST(sum(l_quantity) AS BIGINT) AS max_score, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS ungraded,
 CASE WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN 'not_required' WHEN count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') = 0 THEN 'complete'
  WHEN count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'N') > 0 THEN 'partial' ELSE 'pending' END AS grading_status
FROM lineitem GROUP BY l_orderkey""")
def attempt_totals(t) -> DataFrame:
    """Score with negative marks, and the grading state of descriptive answers (open lines)."""
    flag, desc = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("attempt_id")).agg(
        F.count("*").alias("answers"),
        F.sum(F.when(flag == "A", F.col("l_quantity")).when(flag == "R", -1).otherwise(0)).cast("bigint").alias("score"),
        F.sum("l_quantity").cast("bigint").alias("max_score"),
        F.count_if(desc & (flag == "N")).alias("ungraded"),
        F.count_if(desc).alias("descriptive"),
    )
    state = F.when(F.col("descriptive") == 0, "not_required").when(F.col("ungraded") == 0, "complete").when(F.col("ungraded") < F.col("descriptive"), "partial").otherwise("pending")
    return a.withColumn("grading_status", state).drop("descriptive")


@query("""SELECT doc_id, CASE WHEN q IS NULL THEN 'pending' WHEN x = 1 THEN 'needs_review' WHEN q = 1 THEN 'approved' ELSE 'rejected' END AS status
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id) USING (doc_id)""")
def label_status_gate(t) -> DataFrame:
    labels = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    d = t("documents").select("doc_id").join(labels, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("q").isNull(), "pending").when(F.col("x") == 1, "needs_review").when(F.col("q") == 1, "approved").otherwise("rejected").alias("status"))


@query("SELECT user_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS requests FROM events GROUP BY ALL")
def rate_windows(t) -> DataFrame:
    """Fixed windows of 15 minutes, as a rate limiter counts them."""
    w = t("events").groupBy("user_id", F.window(F.col("ts"), "15 minutes").alias("w")).agg(F.count("*").alias("requests"))
    return w.select("user_id", F.col("w.start").alias("window_start"), "requests")
