"""Scoring, grading states, paper checks and health summaries.

Line items stand for answers, orders for attempts, parts for questions (brand: section).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent
from .ranking import latest
from .registry import query


@query("""WITH q AS (SELECT coalesce(nullif(quality, 0), 0.8) AS c, toxic FROM labels WHERE quality IS NOT NULL ORDER BY doc_id DESC, quality, toxic LIMIT 100)
SELECT count(*) AS sample, floor(avg(c) * 1000 + 0.5) / 10 AS confidence_pct, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS warnings,
 CASE WHEN avg(c) > 0.75 THEN 'healthy' WHEN avg(c) > 0.5 THEN 'warning' ELSE 'critical' END AS health FROM q""")
def health_latest100(t) -> DataFrame:
    """Health over the latest 100 rows; a score of zero counts as 0.8."""
    q = t("labels").where("quality is not null").orderBy(F.desc("doc_id"), "quality", "toxic").limit(100)
    q = q.select(F.coalesce(F.nullif(F.col("quality").cast("double"), F.lit(0.0)), F.lit(0.8)).alias("c"), "toxic")
    mean = F.avg("c")
    band = F.when(mean > 0.75, "healthy").when(mean > 0.5, "warning").otherwise("critical")
    return q.agg(F.count("*").alias("sample"), (F.floor(mean * 1000 + 0.5) / 10).alias("confidence_pct"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("warnings"), band.alias("health"))


_MARKS = "(p_size % 5 + 1)"


@query(f"""SELECT p_brand AS section, count(*) AS questions, CAST(sum({_MARKS}) AS BIGINT) AS total_marks, CAST(arg_min({_MARKS}, p_partkey) AS BIGINT) AS first_marks,
 min({_MARKS}) = max({_MARKS}) AS uniform FROM part GROUP BY p_brand""")
def section_stats(t) -> DataFrame:
    """Of each section: questions, marks, the first question's marks, and whether all are equal."""
    p = t("part").select("p_brand", "p_partkey", F.expr(_MARKS).alias("m"))
    return p.groupBy(F.col("p_brand").alias("section")).agg(
        F.count("*").alias("questions"), F.sum("m").cast("bigint").alias("total_marks"), F.min_by("m", "p_partkey").cast("bigint").alias("first_marks"), (F.min("m") == F.max("m")).alias("uniform")
    )


@query(f"""SELECT s_suppkey AS spec_id, coalesce(n, 0) AS questions, coalesce(m, 0) AS marks,
 concat_ws(',', CASE WHEN coalesce(n, 0) <> s_suppkey % 15 THEN 'questions' END, CASE WHEN coalesce(m, 0) <> s_suppkey % 40 THEN 'marks' END) AS warnings
FROM supplier LEFT JOIN (SELECT p_brand, count(*) AS n, CAST(sum({_MARKS}) AS BIGINT) AS m FROM part GROUP BY p_brand) ON p_brand = 'Brand#' || s_suppkey""")
def paper_totals_check(t) -> DataFrame:
    """Sections against what their specification expects; a warning for each total that differs."""
    made = section_stats(t).select(F.col("section"), F.col("questions").alias("n"), F.col("total_marks").alias("m"))
    spec = t("supplier").select(F.col("s_suppkey").alias("spec_id"), F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("section"))
    j = spec.join(made, "section", "left").select("spec_id", F.coalesce("n", F.lit(0)).alias("questions"), F.coalesce("m", F.lit(0)).alias("marks"))
    off = F.concat_ws(",", F.when(F.col("questions") != F.col("spec_id") % 15, "questions"), F.when(F.col("marks") != F.col("spec_id") % 40, "marks"))
    return j.select("spec_id", "questions", "marks", off.alias("warnings"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 3")
def latest_per_entity(t) -> DataFrame:
    return latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role || ':' || length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations""")
def carry_forward(t) -> DataFrame:
    """Each line with the header above it."""
    above = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("role") != "assistant", F.concat("role", F.lit(":"), F.length("text").cast("string")))
    return t("conversations").select("conv_id", "turn", F.last(header, ignorenulls=True).over(above).alias("header"))


_KIND = "CASE WHEN p_size <= 20 THEN 'mcq' WHEN p_size <= 35 THEN 'numerical' ELSE 'descriptive' END"
_RIGHT = f"CASE WHEN l_returnflag = 'N' THEN NULL WHEN {_KIND} = 'mcq' THEN l_returnflag = 'A' WHEN {_KIND} = 'numerical' THEN abs(l_quantity - p_size) <= 5 END"


@query(f"""SELECT l_orderkey AS attempt_id, count(*) AS answers, count(*) FILTER (l_returnflag = 'N') AS skipped, count(*) FILTER (r) AS right_answers, count(*) FILTER (NOT r) AS wrong_answers,
 CAST(coalesce(sum(CASE WHEN r THEN 4 WHEN NOT r THEN -1 ELSE 0 END), 0) AS BIGINT) AS score,
 CASE WHEN count(*) = 0 THEN 0 ELSE floor(coalesce(sum(CASE WHEN r THEN 4 WHEN NOT r THEN -1 ELSE 0 END), 0) * 1000.0 / (count(*) * 4) + 0.5) / 10 END AS pct
FROM (SELECT l_orderkey, l_returnflag, {_RIGHT} AS r FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey""")
def score_attempts(t) -> DataFrame:
    """Choice answers by equality, numbers within a tolerance of 5, written ones pending; 4
    marks for a right and -1 for a wrong answer, 0 for one that is skipped or pending."""
    a = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity").join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    a = a.select("l_orderkey", "l_returnflag", F.expr(_RIGHT).alias("r"))
    score = F.sum(F.when(F.col("r"), 4).when(~F.col("r"), -1).otherwise(0)).cast("bigint")
    out = a.groupBy(F.col("l_orderkey").alias("attempt_id")).agg(
        F.count("*").alias("answers"), F.count_if(F.col("l_returnflag") == "N").alias("skipped"), F.count_if("r").alias("right_answers"), F.count_if(~F.col("r")).alias("wrong_answers"), score.alias("score")
    )
    return out.withColumn("pct", percent(F.col("score"), F.col("answers") * 4))


_STATES = """SELECT o_orderkey AS attempt_id, any_value(o_orderdate) AS submitted, count(*) FILTER (l_linestatus = 'O') AS written, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS ungraded
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O' GROUP BY o_orderkey"""
_STATE = "CASE WHEN written = 0 THEN 'not_required' WHEN ungraded = 0 THEN 'complete' WHEN ungraded < written THEN 'partial' ELSE 'pending' END"


def _states(t) -> DataFrame:
    written = F.col("l_linestatus") == "O"
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count_if(written).alias("w"), F.count_if(written & (F.col("l_returnflag") == "N")).alias("u"))
    o = t("orders").where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("submitted"), F.coalesce("w", F.lit(0)).alias("written"), F.coalesce("u", F.lit(0)).alias("ungraded"))
    return o.withColumn("state", F.expr(_STATE))


@query(f"SELECT attempt_id, written, ungraded, {_STATE} AS state FROM ({_STATES})")
def grading_state(t) -> DataFrame:
    """How far the written answers of each finished attempt are graded."""
    return _states(t).select("attempt_id", "written", "ungraded", "state")


@query(f"SELECT attempt_id, submitted, state FROM (SELECT *, {_STATE} AS state FROM ({_STATES})) WHERE state IN ('pending', 'partial') ORDER BY submitted, attempt_id")
def grading_queue(t) -> DataFrame:
    """Attempts that wait for grades, first submitted first; the sort is by range over all tasks."""
    return _states(t).where("state in ('pending', 'partial')").select("attempt_id", "submitted", "state").orderBy("submitted", "attempt_id")


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, CAST(len(list_intersect(a, b)) AS BIGINT) AS common,
 array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), ',') AS only_first, CAST(len(list_concat(a, b)) AS BIGINT) AS kept
FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, [split_part(p_name, ' ', 2), lower(p_type)] AS b FROM part)""")
def tag_sets(t) -> DataFrame:
    """Union, intersection, difference and concatenation of two tag lists."""
    p = t("part").select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type")).alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return p.select("p_partkey", text(F.array_union("a", "b")).alias("either"), F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), text(F.array_except("a", "b")).alias("only_first"), F.size(F.concat("a", "b")).cast("bigint").alias("kept"))


@query("SELECT p_brand AS subject, p_type AS chapter, count(*) AS questions, CAST(sum(p_size) AS BIGINT) AS sizes, CAST(grouping(p_brand, p_type) AS BIGINT) AS level FROM part GROUP BY CUBE (p_brand, p_type)")
def subject_cube(t) -> DataFrame:
    p = t("part").select(F.col("p_brand").alias("subject"), F.col("p_type").alias("chapter"), "p_size")
    return p.cube("subject", "chapter").agg(F.count("*").alias("questions"), F.sum("p_size").cast("bigint").alias("sizes"), F.grouping_id().alias("level"))


@query()
def approx_users(t) -> DataFrame:
    """Distinct users of each kind of event, within about 2 %."""
    return t("events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


_TEXT = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, length({_TEXT}) AS n_chars, sha256({_TEXT}) AS digest FROM pages")
def html_strip(t) -> DataFrame:
    """Length and digest of pages without tags, white space made one space."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"[ \t\n\r]+", " "))
    return t("pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<li>([\s\S]*?)</li>', 1), lambda x: ' * ' || trim(regexp_replace(x, '<[^>]+>', ' ', 'g'), ' ')), chr(10)) AS items FROM pages""")
def html_list_items(t) -> DataFrame:
    """List items of a page, a line each, without inner tags."""
    items = F.transform(F.regexp_extract_all("html", F.lit(r"<li>([\s\S]*?)</li>"), F.lit(1)), lambda x: F.concat(F.lit(" * "), F.trim(F.regexp_replace(x, "<[^>]+>", " "))))
    return t("pages").select("page_id", F.array_join(items, "\n").alias("items"))


@query("""SELECT o_custkey AS user_id, count(*) AS attempts, count(*) FILTER (o_orderstatus <> 'O') AS completed, max(o_totalprice) AS best, floor(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) / count(*) + 0.5e0) / 100 AS average FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 50 GROUP BY o_custkey""")
def user_recent50(t) -> DataFrame:
    """Summary of each user's latest fifty attempts; older ones do not count."""
    o = latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 50)
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("attempts"), F.count_if(F.col("o_orderstatus") != "O").alias("completed"), F.max("o_totalprice").alias("best"), (F.floor(F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)) / F.count("*") + 0.5) / 100).alias("average"))
