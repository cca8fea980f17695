"""Rows as they are shown or stored, filters built from parameters, and checks of input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query


def falsy(*values: Column | int) -> Column:
    """The first value that is neither null nor zero, else the last."""
    *some, last = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in some), last)


def iso(ts: Column) -> Column:
    """ISO 8601 with milliseconds, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _tags() -> Column:
    kind = F.when(F.col("p_size") % 4 == 0, "mcq_single").when(F.col("p_size") % 4 == 1, "match_following").when(F.col("p_size") % 4 == 2, F.concat(F.lit("class:"), F.col("p_size").cast("string")))
    return F.array(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("section:"), "p_brand")), kind, F.lit("topic"))


@query("""SELECT p_partkey AS id, p_name AS question_text, CASE WHEN p_size > 40 THEN NULL ELSE p_type END IS NULL AS unassigned, coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_type END, 'General') AS chapter,
 CAST(coalesce(nullif(p_size % 3, 0), nullif(p_size % 5, 0), 4) AS INT) AS marks, s_suppkey AS owner_id, s_name AS owner_name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150""")
def question_rows(t) -> DataFrame:
    """Questions with defaults, marks that are not zero, and their owner, if there is one."""
    chapter = F.when(F.col("p_size") <= 40, F.col("p_type"))
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question_text"), chapter.isNull().alias("unassigned"), F.coalesce(chapter, F.lit("General")).alias("chapter"), falsy(F.col("p_size") % 3, F.col("p_size") % 5, 4).cast("int").alias("marks"))
    s = t("supplier").select(F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("owner_name"))
    return p.join(s, F.col("id") % 150 == F.col("owner_id"), "left")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor(extract('microseconds' FROM ts) % 1000000 / 1000) AS INT)::VARCHAR, 3, '0') || 'Z' AS created_at, event_type AS stage,
 CAST(least(100, 40 + floor(value)) AS BIGINT) AS progress FROM events""")
def upload_rows(t) -> DataFrame:
    """Uploads with the time as text and progress of at most a hundred."""
    return t("events").select("event_id", iso(F.col("ts")).alias("created_at"), F.col("event_type").alias("stage"), F.least(F.lit(100), 40 + F.floor("value")).cast("bigint").alias("progress"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'NEW' END, '') ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 5 = 0 THEN 'name ' || c_custkey ELSE c_name END AS name FROM customer""")
def patched_fields(t) -> DataFrame:
    """Only supplied fields change; an empty reference becomes null."""
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    given = F.create_map(F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("NEW"))
    body = F.when(F.col("c_custkey") % 3 == 0, given).otherwise(F.create_map().cast("map<string,string>"))
    body = F.map_concat(body, F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("name"), F.concat(F.lit("name "), F.col("c_custkey").cast("string")))).otherwise(F.create_map().cast("map<string,string>")))
    c = c.withColumn("body", body)
    value = lambda name, old, blank: F.when(F.map_contains_key("body", name), F.nullif(F.col("body")[name], F.lit("")) if blank else F.col("body")[name]).otherwise(F.col(old))
    return c.select("c_custkey", value("segment", "c_mktsegment", True).alias("segment"), value("name", "c_name", False).alias("name"))


_PLACED = "SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS n FROM lineitem"


def _paper(t) -> DataFrame:
    """Line items of an order as the questions of a paper, in an array by place."""
    q = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(q)).alias("questions"))


@query(f"SELECT l_orderkey AS paper_id, l_orderkey || '-' || (n - 1) AS id, l_partkey AS question_id, CASE WHEN l_quantity < 10 THEN 4e0 ELSE l_quantity END AS marks FROM ({_PLACED})")
def paper_rows(t) -> DataFrame:
    """Questions of a paper with ids made of its id and their place."""
    each = F.transform("questions", lambda q, i: F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), i.cast("string")).alias("id"), q["l_partkey"].alias("question_id"), F.when(q["l_quantity"] < 10, 4.0).otherwise(q["l_quantity"]).alias("marks")))
    return _paper(t).select(F.col("l_orderkey").alias("paper_id"), F.inline(each))


@query(f"""SELECT l_orderkey AS paper_id, chr(CAST(65 + dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first) - 1 AS INT)) AS section, l_returnflag AS name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first, n) AS BIGINT) AS question_number, l_partkey AS question_id
FROM (SELECT *, min(n) OVER (PARTITION BY l_orderkey, l_returnflag) AS first FROM ({_PLACED}))""")
def paper_sections(t) -> DataFrame:
    """Sections A, B, C in the order in which a paper first has them, and numbers across them."""
    q = _paper(t).select(F.col("l_orderkey").alias("paper_id"), F.posexplode("questions").alias("n", "q"))
    first = F.min("n").over(Window.partitionBy("paper_id", "q.l_returnflag"))
    paper = Window.partitionBy("paper_id")
    q = q.withColumn("first", first)
    letter = F.chr((65 + F.dense_rank().over(paper.orderBy("first")) - 1).cast("int"))
    number = F.row_number().over(paper.orderBy("first", "n")).cast("bigint")
    return q.select("paper_id", letter.alias("section"), F.col("q.l_returnflag").alias("name"), number.alias("question_number"), F.col("q.l_partkey").alias("question_id"))


@query(f"""SELECT o_orderkey AS id, o_custkey AS user_id, coalesce(string_agg(n || '=' || l_returnflag, ',' ORDER BY n), '') AS answers, count(n) AS answered FROM orders LEFT JOIN ({_PLACED}) ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey""")
def attempt_rows(t) -> DataFrame:
    """Attempts with their answers by place; attempts without any have an empty list."""
    answers = F.transform(F.coalesce("questions", F.array()), lambda q, i: F.concat_ws("=", (i + 1).cast("string"), q["l_returnflag"]))
    o = t("orders").select("o_orderkey", "o_custkey").join(_paper(t), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.array_join(answers, ",").alias("answers"), F.size(answers).cast("bigint").alias("answered"))


_ACTIVE = "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"


@query(f"SELECT c_custkey AS id, lower(c_mktsegment) AS role, coalesce({_ACTIVE}, true) AS active FROM customer")
def profiles(t) -> DataFrame:
    """Users; one is active unless it is said that it is not."""
    active = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    return t("customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("role"), F.coalesce(active, F.lit(True)).alias("active"))


@query("""SELECT s_suppkey AS id, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END, 'Untitled') AS title, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 0 END, CASE WHEN s_suppkey % 2 = 0 THEN 90 END, 180) AS minutes FROM supplier""")
def paper_body(t) -> DataFrame:
    """Papers with defaults for what is null; zero is a value."""
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("id"), F.coalesce(F.when(k % 4 != 0, F.col("s_name")), F.lit("Untitled")).alias("title"), F.coalesce(F.when(k % 3 == 0, 0), F.when(k % 2 == 0, 90), F.lit(180)).alias("minutes"))


@query(f"""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, p_type) AS section, CASE p_size % 4 WHEN 0 THEN 'mcq single' WHEN 1 THEN 'match following' END AS subtype, CASE WHEN p_size % 4 = 2 THEN p_size END AS class FROM part""")
def tag_labels(t) -> DataFrame:
    """What tags say: the section, else the chapter; the subtype in plain words; the class."""
    tags = F.array_compact("tags")
    starts = lambda p: F.get(F.filter(tags, lambda x: x.startswith(p)), 0)
    sub = F.get(F.filter(tags, lambda x: x.isin("mcq_single", "mcq_multiple", "match_following", "comprehension")), 0)
    p = t("part").withColumn("tags", _tags())
    return p.select("p_partkey", F.coalesce(F.regexp_replace(starts("section:"), "^section:", ""), "p_type").alias("section"), F.translate(sub, "_", " ").alias("subtype"), F.regexp_extract(starts("class:"), "^class:([0-9]+)", 1).try_cast("int").alias("class"))


@query("""SELECT o_orderkey, (s // 60) || 'm ' || (s % 60) || 's' AS short, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 9000 AS s FROM orders)""")
def durations(t) -> DataFrame:
    """Seconds as minutes and seconds, and as on a clock."""
    s = F.floor("o_totalprice") % 9000
    part = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    whole = lambda x: F.floor(x).cast("string")
    short = F.concat(whole(s / 60), F.lit("m "), whole(s % 60), F.lit("s"))
    clock = F.when(s >= 3600, F.concat_ws(":", whole(s / 3600), part(F.floor(s / 60) % 60), part(s % 60))).otherwise(F.concat_ws(":", whole(s / 60), part(s % 60)))
    return t("orders").select("o_orderkey", short.alias("short"), clock.alias("clock"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN chr(CAST(65 + p_partkey % 4 AS INT)) WHEN 1 THEN chr(CAST(65 + p_partkey % 3 AS INT)) || ', ' || chr(CAST(66 + p_partkey % 3 AS INT)) WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE coalesce(CASE WHEN p_size > 20 THEN p_name END, '-') END AS answer,
 CAST(p_partkey // 10 AS BIGINT) AS key_column FROM part""")
def answer_key(t) -> DataFrame:
    """What the answer key prints: a letter, letters, a number or a text; in columns of ten."""
    k, n = F.col("p_partkey"), F.col("p_size") % 4
    letter = lambda i: F.chr(65 + i)
    several = F.array_join(F.transform(F.array(k % 3, k % 3 + 1), letter), ", ")
    answer = F.when(n == 0, letter(k % 4)).when(n == 1, several).when(n == 2, F.col("p_size").cast("string")).otherwise(F.coalesce(F.when(F.col("p_size") > 20, F.col("p_name")), F.lit("-")))
    return t("part").select("p_partkey", answer.alias("answer"), F.floor(k / 10).alias("key_column"))


def clean_number(c: Column) -> Column:
    """A number as it was typed; null for what is none, or only begun."""
    return F.when(c.rlike(r"^-?\d*\.?\d*$") & c.rlike(r"\d"), c.try_cast("double"))


_TYPED = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '-' WHEN 2 THEN '1.5' WHEN 3 THEN 'x1' WHEN 4 THEN '  ' ELSE '-.5' END"


@query(f"SELECT event_id, CASE WHEN regexp_matches(typed, '^-?[0-9]*[.]?[0-9]*$') AND regexp_matches(typed, '[0-9]') THEN TRY_CAST(typed AS DOUBLE) END AS number, nullif(trim(typed, ' '), '') AS said FROM (SELECT event_id, {_TYPED} AS typed FROM events)")
def answer_inputs(t) -> DataFrame:
    """Typed answers: numbers that are no numbers, and blank texts, become null."""
    n = F.col("event_id") % 6
    typed = F.when(n == 0, F.col("event_id").cast("string")).when(n == 1, "-").when(n == 2, "1.5").when(n == 3, "x1").when(n == 4, "  ").otherwise("-.5")
    return t("events").select("event_id", typed.alias("typed")).select("event_id", clean_number(F.col("typed")).alias("number"), F.nullif(F.trim("typed"), F.lit("")).alias("said"))


def question_filter(params: dict) -> Column:
    """Questions of `chapters` (or one `chapter`) and `classes` (or one `class`, bounded by 6 and
    12), of `status`, whose text contains `search`; several beat one."""
    tests = [F.lit(True)]
    chapters = params.get("chapters") or ([params["chapter"]] if params.get("chapter") else [])
    classes = [c for c in params.get("classes") or ([params["class"]] if params.get("class") else []) if 6 <= int(c) <= 12]
    if chapters:
        tests.append(F.col("p_type").isin(chapters))
    if classes:
        tests.append(F.col("p_size").isin([int(c) for c in classes]))
    if params.get("search"):
        tests.append(F.lower("p_name").contains(params["search"].lower()))
    return reduce(Column.__and__, tests)


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size IN (7, 12) AND contains(lower(p_name), 'r')")
def question_list(t) -> DataFrame:
    chosen = question_filter({"chapters": ["ECONOMY", "PROMO"], "chapter": "SMALL", "classes": [5, 7, 12, 13], "search": "R"})
    return t("part").where(chosen).select("p_partkey", "p_type", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderstatus = 'P' AND contains(lower(o_orderpriority), 'urgent')")
def test_list(t) -> DataFrame:
    """What a student may list: open tests; a status that is asked for narrows this, and does not replace it."""
    return t("orders").where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderstatus") == "P") & F.lower("o_orderpriority").contains("urgent")).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 OR (s_nationkey = 7 AND s_acctbal > 0)")
def paper_list(t) -> DataFrame:
    """A member of staff's own papers, and those of others that are published."""
    return t("supplier").where((F.col("s_nationkey") == 3) | ((F.col("s_nationkey") == 7) & (F.col("s_acctbal") > 0))).select("s_suppkey")


def parsed_flag(text: str | None) -> bool | None:
    """The texts true and false as flags; anything else says nothing."""
    return {"true": True, "false": False}.get(text or "")


@query(f"SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND {_ACTIVE}")
def user_list(t) -> DataFrame:
    active = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    flag = parsed_flag("true")
    return t("customer").where(F.lower("c_mktsegment") == "building").where(active == F.lit(flag)).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'small ring'")
def name_equals(t) -> DataFrame:
    """Names that are equal but for case."""
    return t("part").where(F.lower("p_name") == F.lower(F.lit("Small RING"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'red ') AND list_contains(string_split(p_name, ' '), 'widget')")
def tagged_prefix(t) -> DataFrame:
    return t("part").where(F.col("p_name").startswith("red ") & F.array_contains(F.split("p_name", " "), "widget")).select("p_partkey")


_OPEN = "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderdate END"


@query(f"SELECT o_orderkey FROM orders WHERE ({_OPEN} IS NULL OR {_OPEN} <= TIMESTAMP '2000-06-01') AND (o_custkey % 3 = 0 OR o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '2000-06-01')")
def open_windows(t) -> DataFrame:
    """Rows whose time window, open where an end is null, holds the moment."""
    now = F.lit("2000-06-01").cast("timestamp_ntz")
    begin = F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderdate"))
    end = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return t("orders").where((begin.isNull() | (begin <= now)) & (end.isNull() | (now <= end))).select("o_orderkey")


@query("SELECT doc_id, quality = 0 OR toxic = 1 AS low, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE floor((coalesce(quality, 0) * 100e0 + coalesce(1 - toxic, 0) * 70e0) / ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) + 0.5e0) END AS mean FROM labels")
def low_confidence(t) -> DataFrame:
    """Rows with any low score, where null is not low; and the mean of the scores that are there."""
    scores = F.array_compact(F.array(F.col("quality") * 100.0, (1 - F.col("toxic")) * 70.0))
    mean = F.when(F.size(scores) > 0, F.floor(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores) + 0.5).cast("double"))
    return t("labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("low"), mean.alias("mean"))


@query("SELECT o_custkey, count(*) AS asked, count(*) FILTER (o_totalprice > 50000) AS ready, bool_and(o_totalprice > 50000) AS approved FROM orders GROUP BY o_custkey")
def approval_gate(t) -> DataFrame:
    """All of a batch are approved, or none."""
    good = F.col("o_totalprice") > 50000
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("asked"), F.count_if(good).alias("ready"), F.bool_and(good).alias("approved"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_quantity < 5 THEN 'marks' END, CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'outcome' END, CASE WHEN l_discount NOT BETWEEN 0 AND 0.08 THEN 'discount' END, CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' THEN 'dates' END) AS failed FROM lineitem""")
def validations(t) -> DataFrame:
    """Names of the rules that a row breaks: bounds, allowed values, and dates in order."""
    rules = (("marks", F.col("l_quantity") < 5), ("outcome", ~F.col("l_returnflag").isin("A", "R")), ("discount", ~F.col("l_discount").between(0, 0.08)), ("dates", F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", *(F.when(broken, name) for name, broken in rules)).alias("failed"))


#: Milliseconds of a unit of time.
UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


@query("SELECT n_nationkey, CAST(n_nationkey * CASE n_nationkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 60000 WHEN 2 THEN 3600000 ELSE 86400000 END AS BIGINT) AS ms, CAST(ceil((n_nationkey + 1) / 7e0) AS BIGINT) AS pages FROM nation")
def spans_and_pages(t) -> DataFrame:
    """Spans of time such as 15m in milliseconds, and how many pages rows fill."""
    text = F.concat(F.col("n_nationkey").cast("string"), F.substring(F.lit("smhd"), F.col("n_nationkey") % 4 + 1, F.lit(1)))
    unit = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    n = t("nation").select("n_nationkey", text.alias("x"))
    ms = F.regexp_extract("x", r"^(\d+)", 1).cast("bigint") * F.try_element_at(unit, F.regexp_extract("x", "([smhd])$", 1))
    return n.select("n_nationkey", ms.alias("ms"), F.ceil((F.col("n_nationkey") + 1) / 7).alias("pages"))


@query("SELECT p_partkey, 'brand=' || p_brand || ',name=' || p_type || ',size=' || p_size AS entries, 3 AS keys FROM part")
def merged_objects(t) -> DataFrame:
    """Two objects merged, the right one's values last, as entries by key."""
    left = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    right = F.create_map(F.lit("name"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    keys = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))
    value = lambda k: F.coalesce(F.try_element_at(right, k), F.try_element_at(left, k))
    return t("part").select("p_partkey", F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k, value(k))), ",").alias("entries"), F.size(keys).alias("keys"))


_CATEGORY = "CASE WHEN u IN ('MCQ', 'MCQ_SINGLE', 'MCQ_MULTI', 'TRUE_FALSE') THEN 'mcq' WHEN u IN ('NUMERICAL', 'INTEGER') THEN 'numerical' ELSE 'descriptive' END"


@query(f"SELECT event_id, {_CATEGORY} AS category FROM (SELECT event_id, upper(['mcq_single', 'Integer', 'essay', 'MCQ', 'numerical', 'click'][CAST(event_id % 6 AS INT) + 1]) AS u FROM events)")
def question_category(t) -> DataFrame:
    """How a question of some type is scored; unknown types by hand."""
    u = F.upper(F.get(F.array(*(F.lit(x) for x in ("mcq_single", "Integer", "essay", "MCQ", "numerical", "click"))), (F.col("event_id") % 6).cast("int")))
    category = F.when(u.isin("MCQ", "MCQ_SINGLE", "MCQ_MULTI", "TRUE_FALSE"), "mcq").when(u.isin("NUMERICAL", "INTEGER"), "numerical").otherwise("descriptive")
    return t("events").select("event_id", category.alias("category"))
