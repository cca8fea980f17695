"""What editors, dashboards and reports show: validation, confidence, gates, rows of catalogues, dumps."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.dumps import DumpFiles
from .registry import query


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_EDITED = """SELECT p_partkey AS k, substr(p_name, 1, CAST(p_size % 12 AS INT)) AS text, CASE WHEN p_size % 7 <> 0 THEN p_type END AS subject, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS exam,
 [['mcq'], ['mcq_multiple'], ['numerical'], ['descriptive']][1 + CAST(p_partkey % 4 AS INT)][1] AS type, list_transform(range(CAST(p_partkey % 6 AS INT)), lambda i: CASE WHEN i % 3 = 2 THEN ' ' ELSE 'o' || i END) AS options, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size % 4 AS INT) END AS correct, p_size % 4 AS warnings FROM part"""


def _edited(t) -> DataFrame:
    """Questions of an editor: k, text, subject, exam, type, options, correct, warnings (a number)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.get(F.array(*(F.lit(x) for x in ("mcq", "mcq_multiple", "numerical", "descriptive"))), (k % 4).cast("int"))
    options = F.transform(F.slice(F.array(*(F.lit(i) for i in range(6))), F.lit(1), (k % 6).cast("int")), lambda i: F.when(i % 3 == 2, " ").otherwise(F.concat(F.lit("o"), i.cast("string"))))
    return t("part").select(k.alias("k"), F.substring("p_name", F.lit(1), size % 12).alias("text"), F.when(size % 7 != 0, F.col("p_type")).alias("subject"), F.when(size % 5 != 0, F.col("p_brand")).alias("exam"), kind.alias("type"), options.alias("options"), F.when(size % 3 != 0, size % 4).alias("correct"), (size % 4).alias("warnings"))


def missing(text: Column, subject: Column, exam: Column, kind: Column, options: Column, correct: Column) -> Column:
    """What an editor asks for before a question is saved: names, in this order; blank is missing."""
    choice = F.coalesce(kind.isin("mcq", "mcq_multiple"), F.lit(False))
    filled = F.size(F.filter(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.trim(F.coalesce(o, F.lit(""))) != ""))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    tests = {"text": F.length(F.trim(F.coalesce(text, F.lit("")))) < 5, "subject": blank(subject), "exam": blank(exam), "options": choice & (filled < 2), "key": F.coalesce(kind == "mcq", F.lit(False)) & correct.isNull()}
    return F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in tests.items())))


@query(f"""SELECT k, list_filter([CASE WHEN length(trim(text, ' ')) < 5 THEN 'text' END, CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN exam IS NULL THEN 'exam' END, CASE WHEN type LIKE 'mcq%' AND len(list_filter(options, lambda o: trim(o, ' ') <> '')) < 2 THEN 'options' END, CASE WHEN type = 'mcq' AND correct IS NULL THEN 'key' END], lambda x: x IS NOT NULL) AS missing FROM ({_EDITED})""")
def editor_checks(t) -> DataFrame:
    """What is missing before a question can be saved."""
    e = _edited(t)
    return e.select("k", missing(*(F.col(c) for c in ("text", "subject", "exam", "type", "options", "correct"))).alias("missing"))


def editor_confidence(text: Column, kind: Column, options: Column, warnings: Column) -> Column:
    """1, less 0.15 a warning, 0.3 for a choice under two options or 0.1 for other than four, and 0.2
    for a short text; 0.1 at least."""
    n = F.coalesce(F.size(options), F.lit(0))
    choice = F.when(F.coalesce(kind == "mcq", F.lit(False)), F.when(n < 2, 0.3).when(n != 4, 0.1).otherwise(0.0)).otherwise(0.0)
    short = F.when(F.length(F.coalesce(text, F.lit(""))) < 15, 0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.1), 1 - F.coalesce(warnings, F.lit(0)) * 0.15 - choice - short), 6)


@query(f"SELECT k, round(greatest(0.1e0, 1 - warnings * 0.15e0 - CASE WHEN type = 'mcq' THEN CASE WHEN len(options) < 2 THEN 0.3e0 WHEN len(options) <> 4 THEN 0.1e0 ELSE 0 END ELSE 0 END - CASE WHEN length(text) < 15 THEN 0.2e0 ELSE 0 END), 6) AS confidence FROM ({_EDITED})")
def editor_scores(t) -> DataFrame:
    """How far the editor trusts what was read."""
    return _edited(t).select("k", editor_confidence(F.col("text"), F.col("type"), F.col("options"), F.col("warnings")).alias("confidence"))


@query("""WITH e AS (SELECT event_id, value % 1 AS a, (value * 7) % 1 AS b, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (value * 3) % 1 END AS c, event_id % 4 = 0 AS unread FROM events)
SELECT event_id, CASE WHEN unread OR a < 0.7e0 OR b < 0.7e0 OR coalesce(c < 0.7e0, false) THEN 'needs_review' ELSE 'pending' END AS status FROM e""")
def status_gates(t) -> DataFrame:
    """Questions that need review: one that is not read in full, or with a known score under 0.7."""
    v = F.col("value")
    scores = [v % 1, (v * 7) % 1, F.when(F.col("event_id") % 3 != 0, (v * 3) % 1)]
    low = F.greatest(F.lit(False), *(F.coalesce(s < 0.7, F.lit(False)) for s in scores))
    return t("events").select("event_id", F.when((F.col("event_id") % 4 == 0) | low, "needs_review").otherwise("pending").alias("status"))


@query("""SELECT 'topic' AS kind, CAST(c_custkey AS VARCHAR) AS id, CAST(n_nationkey AS VARCHAR) AS subject_id, c_name AS name, n_name AS subject, CAST(NULL AS BOOLEAN) AS is_active FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey
UNION ALL SELECT 'subject', CAST(n_nationkey AS VARCHAR), NULL, n_name, NULL, NULL FROM nation UNION ALL SELECT 'exam', CAST(r_regionkey AS VARCHAR), NULL, r_name, NULL, coalesce(CASE WHEN r_regionkey % 3 = 0 THEN r_regionkey % 2 = 0 END, true) FROM region""")
def dimension_rows(t) -> DataFrame:
    """Subjects, topics with their subject if there is one, and exams, which are active unless told otherwise."""
    none = lambda kind: F.lit(None).cast(kind)
    n = t("nation").select("n_nationkey", "n_name")
    topics = t("customer").join(n.where("n_nationkey % 5 <> 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    told = F.when(F.col("r_regionkey") % 3 == 0, F.col("r_regionkey") % 2 == 0)
    row = lambda kind, key, subject_id, name, subject, active: (F.lit(kind).alias("kind"), key.cast("string").alias("id"), subject_id.cast("string").alias("subject_id"), name.alias("name"), subject.alias("subject"), active.alias("is_active"))
    return topics.select(*row("topic", F.col("c_custkey"), F.col("n_nationkey"), F.col("c_name"), F.col("n_name"), none("boolean"))).union(
        n.select(*row("subject", F.col("n_nationkey"), none("string"), F.col("n_name"), none("string"), none("boolean")))
    ).union(t("region").select(*row("exam", F.col("r_regionkey"), none("string"), F.col("r_name"), none("string"), F.coalesce(told, F.lit(True)))))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_totalprice AS score, round(o_totalprice / 5000, 2) AS percentage, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 3600 AS BIGINT) END, 0) AS time_spent_seconds, CASE WHEN n = 1 THEN rank() OVER (PARTITION BY n = 1 ORDER BY o_totalprice DESC) END AS rank,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS updated_at, CASE WHEN c_custkey % 3 <> 0 THEN c_name || '/' || c_mktsegment END AS profile FROM b LEFT JOIN customer ON o_custkey = c_custkey WHERE n = 1""")
def leaderboard_rows(t) -> DataFrame:
    """A leaderboard as it is shown: all fields, with the profile of users that have one."""
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    b = t("orders").withColumn("n", best).where("n = 1")
    # Ranks by score: each distinct score's place is the number of better rows, summed over scores.
    scores = b.groupBy("o_totalprice").agg(F.count("*").alias("same"))
    above = F.sum("same").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("o_totalprice")).rowsBetween(Window.unboundedPreceding, -1))
    places = scores.select("o_totalprice", (F.coalesce(above, F.lit(0)) + 1).alias("rank"))
    p = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat_ws("/", "c_name", "c_mktsegment")).alias("profile"))
    j = b.join(places, "o_totalprice").join(p, F.col("o_custkey") == F.col("c_custkey"), "left")
    spent = F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3600), F.lit(0))
    return j.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_totalprice").alias("score"), F.round(F.col("o_totalprice") / 5000, 2).alias("percentage"), spent.alias("time_spent_seconds"), "rank", _iso(F.col("o_orderdate")).alias("updated_at"), "profile")


@query("""SELECT 'all' AS of, count(*) AS n, coalesce(avg(o_totalprice), 0) AS mean FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'none', 0, 0 UNION ALL SELECT 'some', count(*), round(coalesce(avg(o_totalprice), 0), 2) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def joined_totals(t) -> DataFrame:
    """Numbers and means after a join, over all rows, over some, and over none: 0 there."""
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    total = lambda rows, name, digits=None: rows.agg(F.lit(name).alias("of"), F.count("*").alias("n"), (F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), digits) if digits else F.coalesce(F.avg("o_totalprice"), F.lit(0.0))).alias("mean"))
    return total(j, "all").union(total(j.where("c_mktsegment = 'no such'"), "none")).union(total(j.where("c_mktsegment = 'BUILDING'"), "some", 2))


@query("""WITH e AS (SELECT event_type AS subject, value % 100 AS confidence, ts, event_id FROM events)
SELECT subject, count(*) AS n, count(*) FILTER (confidence < 50) AS low, CAST(sum(event_id) FILTER (r <= 5) AS BIGINT) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS r FROM e) GROUP BY subject""")
def dashboard_counts(t) -> DataFrame:
    """For each subject the questions, those of low confidence, and the five latest."""
    e = t("events").select(F.col("event_type").alias("subject"), (F.col("value") % 100 < 50).alias("low"), "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))).alias("r"))
    return e.groupBy("subject").agg(F.count("*").alias("n"), F.count_if("low").alias("low"), F.sum(F.when(F.col("r") <= 5, F.col("event_id"))).cast("bigint").alias("recent"))


@query("""SELECT l_orderkey AS paper, l_returnflag AS section, count(*) AS questions, CAST(sum(m) AS BIGINT) AS marks, greatest(3 - count(*), 0) AS required FROM (SELECT *, CASE WHEN l_tax > 0.04e0 THEN CAST(floor(l_quantity) AS INT) % 5 + 1 ELSE 4 END AS m FROM lineitem) GROUP BY ALL""")
def builder_sums(t) -> DataFrame:
    """Questions and marks of a paper's sections as it is put together, and how many are still to come."""
    marks = F.when(F.col("l_tax") > 0.04, F.floor("l_quantity") % 5 + 1).otherwise(4)
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("section")).agg(F.count("*").alias("questions"), F.sum(marks).cast("bigint").alias("marks"))
    return g.withColumn("required", F.greatest(3 - F.col("questions"), F.lit(0)))


REPORT = "summary struct<total:bigint>, evaluations array<struct<k:bigint,name:string>>"


@query("""SELECT p_brand AS report, CASE WHEN ends_with(p_brand, '4') THEN 0 ELSE any_value(total) END AS total, CASE WHEN ends_with(p_brand, '4') THEN 0 ELSE count(*) FILTER (i <= 50) END AS shown, CASE WHEN NOT ends_with(p_brand, '4') THEN CAST(max(p_partkey) FILTER (i <= 50) AS BIGINT) END AS last FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS total FROM part) GROUP BY p_brand""")
def report_summaries(t) -> DataFrame:
    """Reports kept as JSON: their summary and the first fifty evaluations; of broken ones nothing."""
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")))), lambda x: x)
    g = t("part").groupBy("p_brand").agg(each.alias("evaluations"))
    raw = F.to_json(F.struct(F.struct(F.size("evaluations").cast("bigint").alias("total")).alias("summary"), "evaluations"))
    raw = F.when(F.col("p_brand").endswith("4"), F.concat(F.lit("{"), raw)).otherwise(raw)
    r = g.select(F.col("p_brand").alias("report"), F.explode(F.array(F.from_json(raw, REPORT))).alias("r"))
    first = F.slice(F.coalesce("r.evaluations", F.array().cast("array<struct<k:bigint,name:string>>")), 1, 50)
    return r.select("report", F.coalesce("r.summary.total", F.lit(0)).alias("total"), F.size(first).cast("bigint").alias("shown"), F.get(first, F.size(first) - 1)["k"].alias("last"))


@query("SELECT s_name AS name, 'Supplier ' || s_suppkey || chr(10) || s_nationkey AS plain, '<p>' || s_acctbal || '</p>' AS html FROM supplier")
def clipboard_dumps(t) -> DataFrame:
    """Pastes written as dump files, a file each, and read again; the folder must be one that all
    executors mount."""
    s = t("supplier")
    spark = s.sparkSession
    spark.dataSource.register(DumpFiles)
    at = re.sub(r"^file:(?://)?", "", f"{shared_folder(spark)}/dumps-{uuid.uuid4().hex}")
    os.makedirs(at)
    rows = s.select(F.col("s_name").alias("name"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"), F.lit("\n"), F.col("s_nationkey").cast("string")).alias("plain"), F.concat(F.lit("<p>"), F.col("s_acctbal").cast("string"), F.lit("</p>")).alias("html"))
    rows.write.format("dumps").mode("append").save(at)
    return spark.read.format("dumps").load(at).where("error is null").select("name", "plain", "html")

