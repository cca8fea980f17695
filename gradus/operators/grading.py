"""Outcomes, ranks, summaries and selection for attempts and papers.

Orders stand for attempts, line items for answers, parts for questions, nations for tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent, similarity
from .assessment import score_attempts
from .ranking import best, latest, placed_in
from .registry import ORACLES, query


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounded half up."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


_ANSWER = "l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS right_answer, CASE WHEN l_linestatus = 'O' THEN 'text' END AS said, l_quantity > 45 AS left_out, CASE WHEN l_partkey % 3 = 0 THEN 'descriptive' ELSE 'mcq' END AS kind"
_OUTCOME = "CASE WHEN left_out OR (right_answer IS NULL AND said IS NULL) THEN 'skipped' WHEN right_answer THEN 'correct' WHEN NOT right_answer THEN 'wrong' WHEN kind = 'descriptive' AND said IS NOT NULL THEN 'skipped' ELSE 'other' END"


def outcome(right: Column, said: Column, left_out: Column, kind: Column) -> Column:
    """Outcome of an answer by the first rule that holds: left out or empty, right, wrong, a written
    one that waits, anything else."""
    return F.when(left_out | (right.isNull() & said.isNull()), "skipped").when(right, "correct").when(~right, "wrong").when((kind == "descriptive") & said.isNotNull(), "skipped").otherwise("other")


@query(f"""SELECT p_partkey AS question_id, count(o) AS attempts, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'wrong') AS wrong, count(*) FILTER (o = 'skipped') AS skipped,
 CASE WHEN count(o) = 0 THEN 0e0 ELSE floor(count(*) FILTER (o = 'correct') * 100e0 * 10 / count(o) + 0.5e0) / 10 END AS accuracy_pct
FROM part LEFT JOIN (SELECT l_partkey, {_OUTCOME} AS o FROM (SELECT {_ANSWER} FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'O')) ON p_partkey = l_partkey GROUP BY p_partkey""")
def question_outcomes(t) -> DataFrame:
    """Outcomes of finished attempts for each question; questions without answers have zeros."""
    done = t("orders").where("o_orderstatus <> 'O'").select("o_orderkey")
    a = t("lineitem").join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    right = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    said = F.when(F.col("l_linestatus") == "O", "text")
    kind = F.when(F.col("l_partkey") % 3 == 0, "descriptive").otherwise("mcq")
    a = a.select("l_partkey", outcome(right, said, F.col("l_quantity") > 45, kind).alias("o"))
    count = lambda o: F.count_if(F.col("o") == o)
    counts = a.groupBy("l_partkey").agg(F.count("*").alias("attempts"), count("correct").alias("correct"), count("wrong").alias("wrong"), count("skipped").alias("skipped"))
    q = t("part").select(F.col("p_partkey").alias("question_id")).join(counts, F.col("question_id") == F.col("l_partkey"), "left")
    q = q.select("question_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("attempts", "correct", "wrong", "skipped")))
    return q.withColumn("accuracy_pct", percent(F.col("correct"), F.col("attempts")))


@query("""SELECT o_custkey AS user_id, count(*) FILTER (o_orderstatus = 'P') AS pending, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 0e0 ELSE floor(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus = 'F') + 0.5e0) / 100 END AS mean_graded FROM orders GROUP BY o_custkey""")
def graded_mean(t) -> DataFrame:
    """Mean score of graded attempts only, and how many wait; sums are in whole cents."""
    graded = F.col("o_orderstatus") == "F"
    cents = F.sum(F.when(graded, F.floor(F.col("o_totalprice") * 100 + 0.5)))
    n = F.count_if(graded)
    return t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.when(n == 0, 0.0).otherwise(F.floor(cents / n + 0.5) / 100).alias("mean_graded"))


@query("""SELECT o_custkey AS user_id, count(*) AS attempts, CAST(floor(coalesce(avg(s) FILTER (done), 0) + 0.5e0) AS BIGINT) AS mean_score, CAST(greatest(coalesce(max(s) FILTER (done), 0), 0) AS BIGINT) AS best_score FROM
 (SELECT o_custkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS s, o_orderstatus <> 'O' AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 50 GROUP BY o_custkey""")
def user_scores50(t) -> DataFrame:
    """Mean and best of the finished ones among each user's latest fifty attempts; 0 without any."""
    o = latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("s")), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 50)
    done = F.when(F.col("o_orderstatus") != "O", F.col("s"))
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("attempts"), half_up(F.coalesce(F.avg(done), F.lit(0.0))).cast("bigint").alias("mean_score"), F.greatest(F.coalesce(F.max(done), F.lit(0)), F.lit(0)).cast("bigint").alias("best_score"))


@query("SELECT (SELECT count(*) FROM part) AS questions, (SELECT count(*) FROM orders) AS attempts, CAST((SELECT count(*) FROM part) * 2 + (SELECT count(*) FROM orders) * 5 + (SELECT count(*) FROM documents) * 150 AS BIGINT) AS kilobytes")
def storage_estimate(t) -> DataFrame:
    """Storage as a weighted sum of row counts."""
    n = {x: t(x).agg(F.count("*").alias(x)) for x in ("part", "orders", "documents")}
    one = n["part"].join(n["orders"]).join(n["documents"])  # one row each
    return one.select(F.col("part").alias("questions"), F.col("orders").alias("attempts"), (F.col("part") * 2 + F.col("orders") * 5 + F.col("documents") * 150).alias("kilobytes"))


_KIND = "CASE WHEN p_size < 15 THEN 'mcq' WHEN p_size < 25 THEN 'numerical' WHEN p_size < 40 THEN 'descriptive' ELSE 'essay' END"


@query(f"""SELECT coalesce(CASE WHEN p_size > 45 THEN NULL ELSE p_type END, 'unassigned') AS chapter, count(*) AS total, count(*) FILTER (k = 'mcq') AS mcq, count(*) FILTER (k = 'numerical') AS numerical, count(*) FILTER (k = 'descriptive') AS descriptive,
 count(*) FILTER (p_retailprice < 950) AS easy, count(*) FILTER (p_retailprice >= 950 AND p_retailprice < 1050) AS medium, count(*) FILTER (p_retailprice >= 1050) AS hard FROM (SELECT *, {_KIND} AS k FROM part) GROUP BY 1""")
def pool_buckets(t) -> DataFrame:
    """Questions of each chapter in fixed buckets of type and difficulty; other types in no bucket."""
    p, price = F.col("p_size"), F.col("p_retailprice")
    kind = F.when(p < 15, "mcq").when(p < 25, "numerical").when(p < 40, "descriptive")
    level = F.when(price < 950, "easy").when(price < 1050, "medium").otherwise("hard")
    chapter = F.coalesce(F.when(p <= 45, F.col("p_type")), F.lit("unassigned"))
    n = lambda c, v: F.count_if(c == v).alias(v)
    return t("part").groupBy(chapter.alias("chapter")).agg(F.count("*").alias("total"), *(n(kind, v) for v in ("mcq", "numerical", "descriptive")), *(n(level, v) for v in ("easy", "medium", "hard")))


@query("""SELECT CAST(count(*) AS BIGINT) AS pairs, floor(sum(CAST(floor(sim * 1000000) AS BIGINT)) / count(*) / 100 + 0.5e0) / 100 AS mean_similarity_pct, floor(count(*) FILTER (a_type = b_type) * 10000e0 / count(*) + 0.5e0) / 100 AS type_match_pct, CAST(count(*) FILTER (sim < 0.5) AS BIGINT) AS warnings
FROM (SELECT a.p_type AS a_type, b.p_type AS b_type, CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 1e0 ELSE (greatest(length(a.p_name), length(b.p_name)) - levenshtein(lower(a.p_name), lower(b.p_name))) / greatest(length(a.p_name), length(b.p_name))::DOUBLE END AS sim FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)""")
def harness_summary(t) -> DataFrame:
    """Two extractions compared row by row: mean likeness of texts, matches of types, warnings."""
    a = t("part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("a_type"))
    b = t("part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"), F.col("p_type").alias("b_type"))
    j = a.join(b, "p_partkey").withColumn("sim", similarity(F.col("a"), F.col("b")))
    mean = half_up(F.sum(F.floor(F.col("sim") * 1_000_000)) / F.count("*") / 100) / 100
    return j.agg(F.count("*").alias("pairs"), mean.alias("mean_similarity_pct"), (half_up(F.count_if(F.col("a_type") == F.col("b_type")) * 10000.0 / F.count("*")) / 100).alias("type_match_pct"), F.count_if(F.col("sim") < 0.5).alias("warnings"))


@query("""SELECT p_brand, floor(count(*) FILTER (p_size % 4 <> 0) * 1000e0 / count(*) + 0.5e0) / 10 AS explained_pct, floor(count(*) FILTER (len(string_split(p_name, ' ')) >= 2) * 1000e0 / count(*) + 0.5e0) / 10 AS full_options_pct,
 CAST(sum(least(length(p_name), length(p_type)) * 1000 // greatest(length(p_name), length(p_type))) AS BIGINT) AS length_ratio, array_to_string(list_sort(list_distinct(list(p_type) FILTER (p_type NOT IN ('ECONOMY', 'PROMO')))), ',') AS unsupported FROM part GROUP BY p_brand""")
def dataset_metrics(t) -> DataFrame:
    """Rates, length ratios and unsupported tags of each part of a data set."""
    a, b = F.length("p_name"), F.length("p_type")
    tags = F.array_except(F.collect_set("p_type"), F.array(F.lit("ECONOMY"), F.lit("PROMO")))
    return t("part").groupBy("p_brand").agg(
        percent(F.count_if(F.col("p_size") % 4 != 0), F.count("*")).alias("explained_pct"), percent(F.count_if(F.size(F.split("p_name", " ")) >= 2), F.count("*")).alias("full_options_pct"),
        F.sum(F.floor(F.least(a, b) * 1000 / F.greatest(a, b))).cast("bigint").alias("length_ratio"), F.array_join(F.array_sort(tags), ",").alias("unsupported"),
    )


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS pending, count(*) FILTER (toxic = 1) AS needs_review, count(*) FILTER (quality = 0) AS low, (SELECT string_agg(d, ',' ORDER BY d DESC) FROM (SELECT doc_id AS d FROM documents ORDER BY doc_id DESC LIMIT 5)) AS recent
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON documents.doc_id = l.doc_id""")
def moderation_summary(t) -> DataFrame:
    """Counts of the moderation queue, and the latest five."""
    l = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumn("labelled", F.lit(True))
    d = t("documents").select("doc_id").join(l, "doc_id", "left")
    n = d.agg(F.count_if(F.col("labelled").isNull()).alias("pending"), F.count_if(F.col("toxic") == 1).alias("needs_review"), F.count_if(F.col("quality") == 0).alias("low"))
    last = t("documents").select("doc_id").orderBy(F.desc("doc_id")).limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id"), False), lambda x: x.cast("string")), ",").alias("recent"))
    return n.join(last)  # one row each


@query("SELECT conv_id, arg_min(turn, (-(length(text) + 80 * (turn % 4)), turn)) AS turn FROM conversations GROUP BY conv_id")
def best_block(t) -> DataFrame:
    """The block with most text and options; the first of equal ones."""
    score = F.length("text") + 80 * (F.col("turn") % 4)
    return t("conversations").groupBy("conv_id").agg(F.min_by("turn", F.struct((-score).alias("s"), "turn")).alias("turn"))


@query("SELECT p_partkey, CASE WHEN m <= 4 THEN 'four' WHEN m <= 6 THEN 'two' ELSE 'one' END AS layout FROM (SELECT p_partkey, list_max(list_transform(string_split(p_name, ' '), lambda x: length(x))) AS m FROM part)")
def option_layout(t) -> DataFrame:
    """How many options stand in a line, by the longest."""
    m = F.array_max(F.transform(F.split("p_name", " "), F.length))
    return t("part").select("p_partkey", F.when(m <= 4, "four").when(m <= 6, "two").otherwise("one").alias("layout"))


@query("""SELECT page_id, formulas, degraded, CASE WHEN formulas = 0 THEN 100e0 ELSE greatest(0e0, floor((formulas - degraded) * 100e0 / formulas + 0.5e0)) END AS retention_pct FROM
 (SELECT page_id, CAST(len(regexp_extract_all(html, '<b>')) AS BIGINT) AS formulas, CAST(len(regexp_extract_all(html, '<br')) AS BIGINT) AS degraded FROM pages)""")
def preview_metrics(t) -> DataFrame:
    """Marked passages of a page, lost ones, and the share that is kept; 100 without any."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("bigint")
    p = t("pages").select("page_id", n("<b>").alias("formulas"), n("<br").alias("degraded"))
    kept = F.greatest(F.lit(0.0), half_up((F.col("formulas") - F.col("degraded")) * 100.0 / F.col("formulas")))
    return p.withColumn("retention_pct", F.when(F.col("formulas") == 0, 100.0).otherwise(kept))


_BEST = """SELECT c_nationkey AS test_id, o_custkey, o_orderkey, floor(o_totalprice / 10000) AS score, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O' AND c_mktsegment <> 'MACHINERY'
 QUALIFY row_number() OVER (PARTITION BY c_nationkey, o_custkey ORDER BY floor(o_totalprice / 10000) DESC, o_orderdate, o_orderkey) = 1"""


@query(f"""SELECT o_orderkey AS attempt_id, place FROM orders LEFT JOIN (SELECT o_orderkey AS k, CAST(row_number() OVER (PARTITION BY test_id ORDER BY score DESC, o_orderdate, o_custkey) AS BIGINT) AS place FROM ({_BEST})) ON o_orderkey = k""")
def attempt_ranks(t) -> DataFrame:
    """Ranks written back to all attempts: null for those that are not the best of a student."""
    u = t("customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey", F.col("c_nationkey").alias("test_id"))
    o = t("orders").where("o_orderstatus <> 'O'").join(u, F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("test_id", "o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 10000).alias("score"), "o_orderdate")
    first = best(o, ["test_id", "o_custkey"], [F.desc("score"), F.col("o_orderdate"), F.col("o_orderkey")])
    placed = placed_in(first, "test_id", "score", [F.col("o_orderdate"), F.col("o_custkey")]).select(F.col("o_orderkey").alias("k"), "place")
    return t("orders").select(F.col("o_orderkey").alias("attempt_id")).join(placed, F.col("attempt_id") == F.col("k"), "left").drop("k")


@query("SELECT conv_id, turn, CAST(turn % 3 AS BIGINT) AS level, CAST(row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS BIGINT) AS number FROM conversations")
def list_counters(t) -> DataFrame:
    """Numbers of list items: each level counts on, deeper ones are not begun anew."""
    w = Window.partitionBy("conv_id", F.col("turn") % 3).orderBy("turn")
    return t("conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("level"), F.row_number().over(w).cast("bigint").alias("number"))


@query("""SELECT conv_id, g AS option_number, string_agg(role || turn, ' ' ORDER BY turn) AS text FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS g FROM conversations) WHERE g > 0 GROUP BY conv_id, g""")
def continued_options(t) -> DataFrame:
    """Lines that continue an option are added to it, in order."""
    c = t("conversations").withColumn("g", F.count_if(F.col("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn")))
    words = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("w"))))
    return c.where("g > 0").groupBy("conv_id", F.col("g").alias("option_number")).agg(F.array_join(F.transform(words, lambda x: x["w"]), " ").alias("text"))


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high FROM events")
def high_water(t) -> DataFrame:
    """The highest value so far."""
    return t("events").select("event_id", "user_id", F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("high"))


@query("SELECT *, (SELECT count(*) FROM part WHERE p_size < 20) AS total, CAST(ceil((SELECT count(*) FROM part WHERE p_size < 20) / 20e0) AS BIGINT) AS pages FROM (SELECT p_partkey, p_name FROM part WHERE p_size < 20 ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20)")
def paged_totals(t) -> DataFrame:
    """A page of a list, with how many rows and pages there are."""
    rows = t("part").where("p_size < 20").select("p_partkey", "p_name")
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy("p_name", "p_partkey").offset(20).limit(20)
    return shown.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / 20))  # one row


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY chapter NULLS FIRST, p_name, p_partkey) AS BIGINT) AS place FROM (SELECT *, CASE WHEN p_size < 48 THEN p_size END AS chapter FROM part)")
def catalogue_order(t) -> DataFrame:
    """Topics of a subject by number, those without one first, then by name."""
    w = Window.partitionBy("p_brand").orderBy(F.when(F.col("p_size") < 48, F.col("p_size")).asc_nulls_first(), "p_name", "p_partkey")
    return t("part").select("p_partkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_uploads(t) -> DataFrame:
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS tokens FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5) GROUP BY user_id")
def kept_tokens(t) -> DataFrame:
    """The last five tokens of each user, in order."""
    e = latest(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("tokens"))


@query("SELECT conv_id, CAST(turn // 3 AS BIGINT) AS batch, count(*) AS blocks, CAST(40 + floor(least((turn // 3) * 3 + 3, 12) / 12e0 * 50 + 0.5e0) AS BIGINT) AS progress FROM conversations GROUP BY conv_id, turn // 3")
def block_batches(t) -> DataFrame:
    """Blocks in batches of a fixed size, and the progress that each reports."""
    b = F.floor(F.col("turn") / 3)
    c = t("conversations").groupBy("conv_id", b.alias("batch")).agg(F.count("*").alias("blocks"))
    return c.withColumn("progress", (40 + F.floor(F.least(F.col("batch") * 3 + 3, F.lit(12)) / 12 * 50 + 0.5)).cast("bigint"))


_RAW = "regexp_replace(lower(p_name || ' ' || p_type), '[^a-z]', '', 'g')"


@query(f"SELECT min(p_partkey) AS kept, count(*) AS copies FROM (SELECT p_partkey, {_RAW} AS k FROM part) GROUP BY k")
def raw_dedupe(t) -> DataFrame:
    """One row of each normal form."""
    key = F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z]", "")
    return t("part").groupBy(key.alias("k")).agg(F.min("p_partkey").alias("kept"), F.count("*").alias("copies")).drop("k")


@query("SELECT p_partkey, array_to_string(list_filter([p_type, p_brand, CASE WHEN p_name NOT IN (p_type, p_brand) THEN p_name END, CASE WHEN p_size % 2 = 0 THEN 'd' || p_size END], lambda x: x IS NOT NULL), ',') AS images FROM part")
def image_union(t) -> DataFrame:
    """Images by their order, then plain ones, then drawings; the first of equal ones stays."""
    meta = F.array(F.struct(F.lit(2).alias("order"), F.col("p_brand").alias("url")), F.struct(F.lit(1).alias("order"), F.col("p_type").alias("url")))
    drawn = F.array(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("d"), F.col("p_size").cast("string"))))
    every = F.concat(F.transform(F.array_sort(meta), lambda m: m["url"]), F.array("p_name", "p_brand"), drawn)
    return t("part").select("p_partkey", F.array_join(F.array_distinct(F.array_compact(every)), ",").alias("images"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_tax > 0.05 THEN CAST(floor(l_tax * 100 + 0.5) AS BIGINT) END, s_suppkey, 0) AS negative FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) ON l_suppkey = s_suppkey""")
def section_marks(t) -> DataFrame:
    """Marks off for a wrong answer: the question's own, else its section's, else none."""
    s = t("supplier").where("s_suppkey % 2 = 0").select("s_suppkey")
    own = F.when(F.col("l_tax") > 0.05, F.floor(F.col("l_tax") * 100 + 0.5))
    return t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(own, "s_suppkey", F.lit(0)).alias("negative"))


_WORDS = ("ring", "widget", "bolt", "gear")


@query(f"SELECT p_partkey, (SELECT min(i) FROM (VALUES {', '.join(f'({i}, {w!r})' for i, w in enumerate(_WORDS))}) AS c(i, w) WHERE contains(p_name, w)) AS subject FROM part")
def first_match(t) -> DataFrame:
    """The first entry of a catalogue, by its order, whose name a text contains."""
    catalogue = t("part").sparkSession.createDataFrame([(i, w) for i, w in enumerate(_WORDS)], "i int, w string")
    p = t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    hit = p.join(F.broadcast(catalogue), "w").groupBy("p_partkey").agg(F.min("i").alias("subject"))
    return t("part").select("p_partkey").join(hit, "p_partkey", "left")


@query("""SELECT c_custkey, min(s_suppkey) AS topic FROM customer LEFT JOIN supplier ON (CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END IS NULL OR s_nationkey = c_nationkey) AND s_suppkey % 7 = c_custkey % 7 GROUP BY c_custkey""")
def scoped_topics(t) -> DataFrame:
    """The first topic of a subject and class; without a subject, of any."""
    s = t("supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 7).alias("class"))
    of_subject = s.groupBy("s_nationkey", "class").agg(F.min("s_suppkey").alias("narrow"))
    of_any = s.groupBy(F.col("class").alias("any_class")).agg(F.min("s_suppkey").alias("wide"))
    c = t("customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 7).alias("k"), (F.col("c_custkey") % 3 == 0).alias("open"))
    c = c.join(of_subject, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("k") == F.col("class")), "left").join(of_any, F.col("k") == F.col("any_class"), "left")
    return c.select("c_custkey", F.when(F.col("open"), F.col("wide")).otherwise(F.col("narrow")).alias("topic"))


@query("""SELECT o_orderkey AS attempt_id, n.c AS question, coalesce(f, 'not_visited') AS state, coalesce(q, 0e0) AS spent FROM (SELECT o_orderkey FROM orders WHERE o_custkey < 100) CROSS JOIN (SELECT unnest(range(1, 8)) AS c) n
 LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, max(l_quantity) AS q FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey AND l_linenumber = n.c""")
def saved_answers(t) -> DataFrame:
    """The questions of a paper with saved answers, and defaults where there are none."""
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("question")).agg(F.min("l_returnflag").alias("f"), F.max("l_quantity").alias("q"))
    o = t("orders").where("o_custkey < 100").select(F.col("o_orderkey").alias("attempt_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("question"))
    return o.join(a, ["attempt_id", "question"], "left").select("attempt_id", F.col("question").cast("bigint").alias("question"), F.coalesce("f", F.lit("not_visited")).alias("state"), F.coalesce("q", F.lit(0.0)).alias("spent"))


@query("""SELECT o_orderkey AS attempt_id, p_partkey AS question_id, CAST(coalesce(nullif(floor(l_discount * 100 + 0.5), 0), nullif(p_size % 5, 0), 1) AS BIGINT) AS max_marks, o_custkey % 5 = 0 OR p_size % 2 = 0 AS may_read
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P'""")
def attempt_detail(t) -> DataFrame:
    """Answers with the marks they could have: the answer's own, else the question's, else one; and
    whether the reader owns the test or the answer."""
    o = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    a = o.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    marks = F.coalesce(F.nullif(F.floor(F.col("l_discount") * 100 + 0.5), F.lit(0)), F.nullif(F.col("p_size") % 5, F.lit(0)), F.lit(1)).cast("bigint")
    return a.select(F.col("o_orderkey").alias("attempt_id"), F.col("p_partkey").alias("question_id"), marks.alias("max_marks"), ((F.col("o_custkey") % 5 == 0) | (F.col("p_size") % 2 == 0)).alias("may_read"))


@query("SELECT o_orderkey AS attempt_id, c_name AS user_name, o_orderdate AS submitted FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC")
def attempt_history(t) -> DataFrame:
    """A user's attempts, the latest first."""
    u = t("customer").where("c_custkey = 7").select("c_custkey", F.col("c_name").alias("user_name"))
    o = t("orders").where("o_custkey = 7").join(u, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("attempt_id"), "user_name", F.col("o_orderdate").alias("submitted")).orderBy(F.desc("submitted"), F.desc("attempt_id"))


@query("""SELECT c_custkey AS user_id, max(o_orderkey) FILTER (o_orderstatus = 'O') AS resumed, max(o_orderkey) FILTER (o_orderstatus = 'O') IS NULL AND count(o_orderkey) FILTER (o_orderstatus <> 'O') < 12 AS created, count(o_orderkey) FILTER (o_orderstatus <> 'O') + 1 AS number
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def started_attempts(t) -> DataFrame:
    """An open attempt is resumed; else one begins, if the user has some left."""
    n = t("orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("resumed"), F.count_if(F.col("o_orderstatus") != "O").alias("done"))
    c = t("customer").select(F.col("c_custkey").alias("user_id")).join(n, F.col("user_id") == F.col("o_custkey"), "left")
    done = F.coalesce("done", F.lit(0))
    return c.select("user_id", "resumed", (F.col("resumed").isNull() & (done < 12)).alias("created"), (done + 1).alias("number"))


_SUBMITTED = f"""SELECT s.attempt_id, s.score, s.pct, CASE WHEN p.place IS NULL THEN 'unranked' ELSE 'ranked' END AS state, p.place FROM ({ORACLES['score_attempts']}) s LEFT JOIN (SELECT o_orderkey AS attempt_id, place FROM orders LEFT JOIN (SELECT o_orderkey AS k, CAST(row_number() OVER (PARTITION BY test_id ORDER BY score DESC, o_orderdate, o_custkey) AS BIGINT) AS place FROM ({_BEST})) ON o_orderkey = k) p USING (attempt_id)"""


@query(_SUBMITTED)
def submitted_attempts(t) -> DataFrame:
    """Attempts scored answer by answer, with the rank of each that is a student's best."""
    s = score_attempts(t).select("attempt_id", "score", "pct").join(attempt_ranks(t), "attempt_id", "left")
    return s.select("attempt_id", "score", "pct", F.when(F.col("place").isNull(), "unranked").otherwise("ranked").alias("state"), "place")
