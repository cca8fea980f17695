"""Formulas and texts of a question bank put right, with the answers they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, latex
from .registry import query


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(t, '(?i)\bNormal\s+0\b', ' ', 'g'), '(?i)\bMsoNormal\b', ' ', 'g'), chr(160), ' '), '[""" + "\u200b-\u200d\ufeff" + r"""]', '', 'g'), '[^""" + latex.SAFE.replace("'", "''") + r"""]', '', 'g') AS t FROM d)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS said FROM c""")
def safe_documents(t) -> DataFrame:
    """Texts of documents with the characters that a question needs."""
    return t("documents").select("doc_id", latex.safe_text(F.coalesce("text", F.lit(""))).alias("said"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, nullif(upper(regexp_extract(t, '""" + latex.ANSWER + r"""', 1)), '') AS letter, ascii(nullif(upper(regexp_extract(t, '""" + latex.ANSWER + r"""', 1)), '')) - 65 AS place FROM d""")
def named_answers(t) -> DataFrame:
    """The answer that a text names, as a letter and as an option's place."""
    letter, place = latex.answer_in(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", letter.alias("letter"), place.alias("place"))


@query(r"""WITH p AS (SELECT p_partkey, p_size, p_type, p_partkey % 7 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '$x \le ' || p_size || '$' WHEN 1 THEN '$$\frac{' || p_size || '}{' || p_partkey || '} \times 2$$' WHEN 2 THEN lower(p_type) || '-' || lower(p_type) WHEN 3 THEN '$\sqrt {' || p_size || '}$' WHEN 4 THEN '$P(A \cap B) = ' || p_size || '$' WHEN 5 THEN '$foo \alpha ' || p_size || '$' ELSE '$$a} b{' || p_size || '$$' END AS said FROM p""")
def formula_regions(t) -> DataFrame:
    """Formulas as they are kept: signs, operators, fractions, braces and unknown commands put right."""
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    low = F.lower("p_type")
    raw = [
        F.concat(F.lit(" $x <=  "), size, F.lit("$")),
        F.concat(F.lit("$$"), size, F.lit(" / "), F.col("p_partkey").cast("string"), F.lit(" * 2$$")),
        F.concat(low, F.lit("-"), low),
        F.concat(F.lit("\\(√{"), size, F.lit("\\)")),
        F.concat(F.lit("P(A ∩ B) = "), size),
        F.concat(F.lit("$\\foo α\n"), size, F.lit("$")),
        F.concat(F.lit("\\[a} b{"), size, F.lit("\\]")),
    ]
    return t("part").select("p_partkey", latex.region(F.coalesce(*(F.when(k == i, c) for i, c in enumerate(raw)))).alias("said"))


@query(r"""SELECT p_partkey, p_name || ' x^{' || p_size || '} and a_{' || p_brand || '} \mathbf{' || p_type || '}' || chr(10) || CASE WHEN p_size % 2 = 0 THEN chr(10) || '$$y = ' || p_size || ' & 1$$' ELSE 'plain < ' || p_partkey END AS said FROM part""")
def scripts_as_latex(t) -> DataFrame:
    """A word processor's HTML with raised, lowered and bold text and displayed formulas."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    tail = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<p style="a" class="x equation y">y = '), size, F.lit(" &amp; 1</p>"))).otherwise(F.concat(F.lit("<p>plain &lt; <i>"), key, F.lit("</i></p>")))
    html = F.concat(F.lit("<p><em>"), "p_name", F.lit("</em> x<sup>"), size, F.lit("</sup> and a<SUB>"), "p_brand", F.lit("</SUB> <strong>"), "p_type", F.lit("</strong></p>"), tail)
    return t("part").select("p_partkey", latex.with_scripts(html).alias("said"))


@query("""SELECT p_partkey, list_filter(['section:' || CASE WHEN p_size % 3 <> 0 THEN p_type END, 'qnum:' || CAST(p_size AS VARCHAR), CASE WHEN p_size % 5 <> 0 THEN 'class:' || (6 + p_size % 7) END], lambda x: x IS NOT NULL) AS tags, CASE WHEN p_size % 3 <> 0 THEN p_type END AS section, CAST(CASE WHEN p_size % 5 <> 0 THEN 6 + p_size % 7 END AS INT) AS class FROM part""")
def tags_encoded(t) -> DataFrame:
    """Section, number and class as tags, and read back from them."""
    size = F.col("p_size")
    fields = {"section": F.when(size % 3 != 0, F.col("p_type")), "qnum": size.cast("string"), "class": F.when(size % 5 != 0, (6 + size % 7).cast("string"))}
    tags = F.array_compact(F.array(*(F.concat(F.lit(f"{n}:"), c) for n, c in fields.items())))
    back = lambda n: F.get(F.filter("tags", lambda x: x.startswith(f"{n}:")), 0)
    p = t("part").select("p_partkey", tags.alias("tags"))
    return p.select("p_partkey", "tags", F.regexp_replace(back("section"), "^section:", "").alias("section"), F.regexp_extract(back("class"), "^class:([0-9]+)", 1).try_cast("int").alias("class"))


@query("""WITH c AS (SELECT n_nationkey AS i, replace(lower(n_name), '_', ' ') AS name, CAST(n_nationkey AS VARCHAR) AS code FROM nation), x AS (SELECT s_suppkey, 'paper of nation ' || s_nationkey || ' by ' || lower(s_name) AS t FROM supplier)
SELECT s_suppkey, (SELECT min(i) FROM c WHERE contains(t, name) OR (length(code) > 2 AND contains(t, code))) AS entry FROM x""")
def first_contained(t) -> DataFrame:
    """The first entry of a catalogue, by its order, whose name or long code a text contains: whole
    phrases.  The catalogue is cut to as many words as its longest name, and texts meet it by runs
    of words, so that no text is held against every entry."""
    entries = t("nation").select(F.col("n_nationkey").alias("i"), F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")).alias("name"))
    texts = t("supplier").select("s_suppkey", F.concat(F.lit("paper of nation "), F.col("s_nationkey").cast("string"), F.lit(" by "), F.lower("s_name")).alias("t"))
    return first_phrase(texts, entries, "s_suppkey", "t").select("s_suppkey", "entry")


def first_phrase(texts: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """key and entry: the smallest `i` of entries (i, name) whose name stands in the text, inside
    words too; null without any.

    A name that stands in a text begins inside or at one of its words.  Texts are looked up by the
    name's letters: each place of a text gives the next LEAD characters, which name its entries.
    """
    lead = lambda c: F.substring(c, 1, LEAD)
    named = entries.where("name <> ''").select("i", "name", F.length("name").alias("n"), lead("name").alias("lead"))
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    leads = F.array_distinct(F.flatten(F.transform(at, lambda p: F.transform(F.sequence(F.lit(1), F.lit(LEAD)), lambda n: F.substr(F.col(text), p, n)))))
    met = texts.select(key, text, F.explode(leads).alias("lead")).join(named, "lead").where(F.contains(F.col(text), F.col("name")))
    best = met.groupBy(key).agg(F.min("i").alias("entry"))
    return texts.select(key).join(best, key, "left")


#: Characters of a name by which texts find it.
LEAD = 4


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey AS c, 'Order ' || o_orderkey || ' of ' || o_orderpriority AS head, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, o_orderkey, 'x ' || 'Order ' || o_orderkey || ' of ' || o_orderpriority || ' more' AS text FROM orders WHERE o_orderkey % 3 <> 0)
SELECT b.k, coalesce(z.o_orderkey, (SELECT min(s.o_orderkey) FROM s WHERE s.c = b.c AND contains(s.text, b.head))) AS segment FROM b LEFT JOIN s z ON z.c = b.c AND z.i = b.i""")
def aligned_segments(t) -> DataFrame:
    """Blocks of a document with its segments: by place, else by the head of the text."""
    head = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), "o_orderpriority")
    b = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), head.alias("head"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("i"))
    s = t("orders").where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("segment"), F.concat(F.lit("x "), head, F.lit(" more")).alias("text"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("i"))
    placed = b.join(s.select("c", "i", "segment"), ["c", "i"], "left")
    rest = placed.where("segment is null").drop("segment", "i")
    by_text = rest.join(s, "c").where(F.contains(F.col("text"), F.col("head"))).groupBy("k").agg(F.min("segment").alias("segment"))
    return placed.where("segment is not null").select("k", "segment").union(rest.select("k").join(by_text, "k", "left"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, o_orderpriority AS paper, c_mktsegment AS chapter, n_name AS nation, r_name AS region FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def populated_chain(t) -> DataFrame:
    """Rows with what they refer to, over four steps; a broken reference leaves nulls."""
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    o = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("paper"))
    c = t("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("chapter"))
    n = t("nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("nation"))
    r = t("region").select("r_regionkey", F.col("r_name").alias("region"))
    near = c.join(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    up = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(near, F.col("o_custkey") == F.col("c_custkey"), "left")
    return up.select(*l.columns, "paper", "chapter", "nation", "region")


@query("""SELECT o_orderkey AS id, 'p' || o_custkey AS paper_id, CASE WHEN c_custkey % 4 <> 0 THEN c_name || '|' || coalesce(n, 0) END AS paper, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'code' || o_orderkey END AS access_code FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL) ON k = c_custkey""")
def online_tests(t) -> DataFrame:
    """Tests as they are shown, with their paper inside if it has a title."""
    n = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    paper = t("customer").where("c_custkey % 4 <> 0").join(n, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.struct(F.col("c_name").alias("title"), F.coalesce("n", F.lit(0)).alias("questions")).alias("paper"))
    o = t("orders").join(paper, F.col("o_custkey") == F.col("c_custkey"), "left")
    shown = F.when(F.col("paper").isNotNull(), F.concat_ws("|", "paper.title", F.col("paper.questions").cast("string")))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("paper_id"), shown.alias("paper"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("code"), F.col("o_orderkey").cast("string"))).alias("access_code"))


@query("""WITH s AS (SELECT o_orderkey, 'T-' || o_orderkey || '-' || o_orderpriority AS code, CASE WHEN o_orderstatus = 'P' THEN 'draft' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'scheduled' WHEN o_orderdate + INTERVAL 400 DAY < TIMESTAMP '1998-01-01' THEN 'completed' ELSE 'active' END AS status FROM orders)
SELECT o_orderkey, code FROM s WHERE contains(lower(code), lower('-1-Ur')) AND status = 'completed'""")
def filtered_tests(t) -> DataFrame:
    """Tests by a part of their code, in any case, and by the status that the clock gives them."""
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    code = F.concat(F.lit("T-"), F.col("o_orderkey").cast("string"), F.lit("-"), "o_orderpriority")
    start = F.col("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "draft").when(start > now, "scheduled").when(start + F.make_dt_interval(days=F.lit(400)) < now, "completed").otherwise("active")
    s = t("orders").select("o_orderkey", code.alias("code"), status.alias("status"))
    return s.where(F.contains(F.lower("code"), F.lower(F.lit("-1-Ur"))) & (F.col("status") == "completed")).select("o_orderkey", "code")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type, max(ts) OVER (PARTITION BY user_id) AS last FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS edit, CASE WHEN next_ts IS NULL THEN 'unmount' WHEN next_type = 'view' AND next_ts <= ts + INTERVAL 30 MINUTE THEN 'navigation' ELSE 'pause' END AS why FROM e WHERE event_type = 'click' AND (next_ts IS NULL OR next_type = 'view' OR next_ts > ts + INTERVAL 30 MINUTE)""")
def saved_edits(t) -> DataFrame:
    """Edits that are saved: the last before a pause, before a change of page, and at the end."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").where("event_type in ('click', 'view')").select("user_id", "event_id", "ts", "event_type", F.lead("ts").over(w).alias("next_ts"), F.lead("event_type").over(w).alias("next_type"))
    late = F.col("next_ts") > F.col("ts") + F.make_dt_interval(mins=F.lit(30))
    saved = F.col("next_ts").isNull() | (F.col("next_type") == "view") | late
    why = F.when(F.col("next_ts").isNull(), "unmount").when((F.col("next_type") == "view") & ~late, "navigation").otherwise("pause")
    return e.where((F.col("event_type") == "click") & saved).select("user_id", F.col("event_id").alias("edit"), why.alias("why"))


@query(r"""WITH p AS (SELECT p_partkey, p_name, p_size % 10 AS d, chr(CAST(97 + p_size % 26 AS INT)) AS v, p_partkey % 5 AS k FROM part),
q AS (SELECT *, contains('abcdnopxyz', v) AND d >= 2 AND (k IN (0, 1)) AS up FROM p)
SELECT p_partkey, CASE k WHEN 0 THEN 'Let ' ELSE p_name || ' ' END || v || CASE WHEN up THEN '^' ELSE '' END || d || CASE k WHEN 0 THEN ' + 1 of \frac{1}{2}' WHEN 1 THEN ' in $k$' WHEN 2 THEN ' of version2, part 3' WHEN 3 THEN ' at https://a.b/?q=1' ELSE ' <b class="x">' END AS said FROM q""")
def shorthand_powers(t) -> DataFrame:
    """Shorthand formulas in full, and powers where mathematics stands near."""
    k, d = F.col("p_partkey") % 5, (F.col("p_size") % 10).cast("string")
    tails = (" + 1 of \u00bd", " in $k$", " of version2, part 3", " at https://a.b/?q=1", ' <b class="x">')
    tail = F.coalesce(*(F.when(k == i, x) for i, x in enumerate(tails)))
    raw = F.concat(F.when(k == 0, "Let ").otherwise(F.concat("p_name", F.lit(" "))), F.chr(97 + F.col("p_size") % 26), d, tail)
    return t("part").select("p_partkey", latex.with_powers(cleaning.prepared_math(raw)).alias("said"))
