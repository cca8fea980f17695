"""Evidence from several places: the nearest mark before, a document's metadata, ranked sources, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intake as read
from ..sources.dumps import numbered, report
from ..sources.markup import html_nodes, with_nodes
from .registry import query


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], on: list[str], take: list[str]) -> DataFrame:
    """`rows` with the fields `take` of the last of `marks` that is not after each, by `on`; null
    before the first.  At equal places a mark holds; of marks at one place the largest by `take`.

    Both meet in one sorted pass over their union, by the keys `by`: a row for each row, repeated
    ones too.  A null key is a key.
    """
    others = [c for c in rows.columns if c not in by + on]
    mark = F.struct(*take)
    m = marks.select(*by, *on, F.lit(0).alias("__kind"), mark.alias("__mark"), F.lit(None).cast(rows.select(F.struct(*others) if others else F.lit(1)).schema[0].dataType).alias("__row"))
    r = rows.select(*by, *on, F.lit(1).alias("__kind"), F.lit(None).cast(marks.select(mark).schema[0].dataType).alias("__mark"), (F.struct(*others) if others else F.lit(1)).alias("__row"))
    w = Window.partitionBy(*by).orderBy(*on, "__kind", "__mark").rowsBetween(Window.unboundedPreceding, 0)
    held = m.unionByName(r).withColumn("__held", F.last("__mark", ignorenulls=True).over(w)).where("__kind = 1")
    return held.select(*by, *on, *(F.col("__row")[c].alias(c) for c in others), *(F.col("__held")[c].alias(c) for c in take))


@query("""WITH v AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, max({'e': event_id, 'v': value}) AS m FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT v.user_id, v.ts, v.event_id, c.m.e AS mark_id, c.m.v AS mark_value FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts""")
def asof_marks(t) -> DataFrame:
    """For each purchase the last look before it."""
    e = t("events")
    marks = e.where("event_type in ('click', 'view')").select("user_id", "ts", F.col("event_id").alias("mark_id"), F.col("value").alias("mark_value"))
    return as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), marks, ["user_id"], ["ts"], ["mark_id", "mark_value"])


def option_images(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """Images that belong to options: keys, label, place of the image in its option, src.

    An image belongs to the last option marker before it in the page; images before the first one
    belong to the stem and give no row.  Of a text with several markers the last counts.
    """
    n = with_nodes(pages, html_nodes, html, *keys, fields=("id", "name", "attributes", "text"))
    marker = lambda x: F.nullif(F.element_at(F.concat(F.array(F.lit("")), read.marker_labels(x["text"])), -1), F.lit(""))
    found = F.filter("nodes", lambda x: (x["name"] == "img") | x["text"].rlike(read.OPTION_MARK))
    row = lambda x: F.struct(x["id"].alias("at"), F.when(x["name"] != "img", marker(x)).alias("mark"), F.when(x["name"] == "img", F.try_element_at(x["attributes"], F.lit("src"))).alias("src"))
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = n.select(*keys, F.inline(F.transform(found, row))).withColumn("label", F.last("mark", ignorenulls=True).over(before))
    held = rows.where("src is not null and label is not null")
    place = F.row_number().over(Window.partitionBy(*keys, "label").orderBy("at"))
    return held.select(*keys, F.upper("label").alias("label"), place.alias("place"), "src")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem),
e AS (SELECT l_orderkey, 2 * i AS o, CASE WHEN l_returnflag = 'N' THEN chr(CAST(64 + least(i, 6) AS INT)) END AS label, CASE WHEN l_returnflag <> 'N' THEN 'p' || l_partkey || '.png' END AS src FROM l),
h AS (SELECT i.l_orderkey, i.src, i.o, m.label FROM (SELECT * FROM e WHERE src IS NOT NULL) i ASOF JOIN (SELECT * FROM e WHERE label IS NOT NULL) m ON i.l_orderkey = m.l_orderkey AND i.o >= m.o)
SELECT l_orderkey, label, CAST(row_number() OVER (PARTITION BY l_orderkey, label ORDER BY o) AS INT) AS place, src FROM h""")
def images_of_options(t) -> DataFrame:
    """Images put to the options they follow, in pages of as many parts as an order has lines."""
    own = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*own))
    part = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("<p>("), F.chr(64 + F.least(F.col("i"), F.lit(6))), F.lit(") choice</p>"))).otherwise(F.concat(F.lit("<img alt='' src=\"p"), F.col("l_partkey").cast("string"), F.lit('.png">')))
    l = t("lineitem").withColumn("i", i).select("l_orderkey", "i", part.alias("part"))
    pages = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "\n").alias("html"))
    return option_images(pages, "html", "l_orderkey")


#: Characters of a document that say what it is about.
HEADER = 3500


def document_metadata(docs: DataFrame, text: str, *keys: str, default: int = 11) -> DataFrame:
    """What a document's head says of all its questions: keys, classes, class, exam, mixed, and
    the confidence in class and exam.  The first class found is the default one; without any, `default`."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEADER)
    d = docs.select(*keys, read.classes(head).alias("classes"), read.exam(head).alias("exam"))
    n = F.size("classes")
    sure = F.when(n == 1, 0.85).when(n > 1, 0.4).otherwise(0.6)
    return d.select(*keys, "classes", F.coalesce(F.get("classes", F.lit(0)), F.lit(default)).alias("class"), "exam", (n > 1).alias("mixed"), sure.alias("class_confidence"), F.when(F.col("exam").isNotNull(), 0.75).otherwise(0.2).alias("exam_confidence"))


def ranked(field: str, *sources: str) -> Column:
    """A field from the first source (a struct column, or null) that has it."""
    return F.coalesce(*(F.col(s)[field] for s in sources))


def merged_evidence(questions: DataFrame) -> DataFrame:
    """Questions with what rules, semantic matches and a model say, as one: class, subject, exam,
    difficulty, tags, confidence (0 to 100), status, providers.

    questions: key, document (class, exam), rules, semantic, model (structs with class, subject,
    exam, difficulty, confidence, tags; null if one has nothing), difficulty.  Rules come first,
    then matches, then the model; the document's class and exam stand for what no one says.
    Difficulty is of the rules, else the model's, else what the text suggests.  Confidence is the
    mean of those who have any, 0.3 for rules without; under 55, or without subject or exam, a
    question needs review.
    """
    sources = ("rules", "semantic", "model")
    own = F.coalesce(F.nullif(F.col("rules.confidence"), F.lit(0.0)), F.lit(0.3))
    others = F.filter(F.array("semantic.confidence", "model.confidence"), lambda c: F.coalesce(c, F.lit(0.0)) > 0)
    every = F.concat(F.array(own), others)
    mean = F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.size(every)
    confidence = F.floor(mean * 100 + 0.5).cast("int")
    subject = F.coalesce(F.col("rules.subject"), F.col("semantic.subject"))
    exam = F.coalesce(F.col("rules.exam"), F.col("semantic.exam"), F.col("document.exam"))
    tags = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.col(s)["tags"], F.array().cast("array<string>")) for s in ("rules", "model")))))
    review = subject.isNull() | exam.isNull() | (confidence < 55)
    providers = F.concat_ws("+", F.lit("rules"), F.lit("semantic"), F.when(F.col("model").isNotNull(), "model"))
    return questions.select("key", F.coalesce(ranked("class", *sources), F.col("document.class")).alias("class"), subject.alias("subject"), exam.alias("exam"), F.coalesce(F.col("rules.difficulty"), F.col("model.difficulty"), F.col("difficulty")).alias("difficulty"), F.array_join(tags, ",").alias("tags"), confidence.alias("confidence"), F.when(review, "needs_review").otherwise("pending").alias("status"), providers.alias("providers"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_type AS ty, p_brand AS b, p_name AS nm FROM part),
q AS (SELECT k, CASE WHEN k % 2 = 0 THEN s % 7 + 6 WHEN k % 3 = 0 THEN 8 WHEN k % 5 = 0 THEN 12 WHEN s % 2 = 0 THEN 9 ELSE 11 END AS class, CASE WHEN k % 4 <> 1 THEN ty WHEN k % 3 = 0 THEN b END AS subject, CASE WHEN k % 6 = 0 THEN 'r' WHEN k % 3 = 0 AND s % 2 = 1 THEN 'm' WHEN s % 3 = 0 THEN 'NEET' END AS exam,
 CASE WHEN k % 7 = 0 THEN 'hard' WHEN k % 5 = 0 THEN 'easy' ELSE 'medium' END AS difficulty, CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 'a,' || b || ',z' WHEN k % 5 = 0 THEN b || ',z' WHEN k % 2 = 0 THEN 'a,' || b ELSE b END AS tags,
 (CASE WHEN k % 10 = 0 THEN 0.3e0 ELSE s / 50e0 END + CASE WHEN k % 3 = 0 THEN 0.5e0 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.9e0 ELSE 0 END) / (1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) AS c, k % 5 = 0 AS m FROM p)
SELECT k AS key, CAST(class AS INT) AS class, subject, exam, difficulty, tags, CAST(floor(c * 100 + 0.5) AS INT) AS confidence, CASE WHEN subject IS NULL OR exam IS NULL OR CAST(floor(c * 100 + 0.5) AS INT) < 55 THEN 'needs_review' ELSE 'pending' END AS status, 'rules+semantic' || CASE WHEN m THEN '+model' ELSE '' END AS providers FROM q""")
def classified_questions(t) -> DataFrame:
    """Evidence of rules, matches and a model on questions, with what their document's head says."""
    k, s = F.col("p_partkey"), F.col("p_size")
    none = lambda kind: F.lit(None).cast(kind)
    source = lambda **f: F.struct(*(f.get(n, none(kind)).cast(kind).alias(n) for n, kind in (("class", "int"), ("subject", "string"), ("exam", "string"), ("difficulty", "string"), ("confidence", "double"), ("tags", "array<string>"))))
    head = F.concat(F.when(s % 2 == 0, "Paper of class 9"), F.when(s % 3 == 0, " for NEET").otherwise(" for all"))
    head = F.coalesce(head, F.when(s % 3 == 0, "Paper for NEET").otherwise("Paper"))
    docs = document_metadata(t("part").select("p_partkey", head.alias("head")), "head", "p_partkey").select("p_partkey", F.struct("class", "exam").alias("document"))
    tags = F.when(k % 2 == 0, F.array(F.lit("a"), F.col("p_brand"))).otherwise(F.array("p_brand", "p_brand"))
    rules = source(**{"class": F.when(k % 2 == 0, s % 7 + 6)}, subject=F.when(k % 4 != 1, F.col("p_type")), exam=F.when(k % 6 == 0, "r"), difficulty=F.when(k % 7 == 0, "hard"), confidence=F.when(k % 10 != 0, s / 50.0).otherwise(F.lit(0.0)), tags=tags)
    semantic = F.when(k % 3 == 0, source(**{"class": F.lit(8)}, subject=F.col("p_brand"), exam=F.when(s % 2 == 1, "m"), confidence=F.lit(0.5)))
    model = F.when(k % 5 == 0, source(**{"class": F.lit(12)}, subject=F.lit("never"), difficulty=F.lit("easy"), confidence=F.lit(0.9), tags=F.array("p_brand", F.lit("z"))))
    q = t("part").select("p_partkey", k.alias("key"), rules.alias("rules"), semantic.alias("semantic"), model.alias("model"), F.lit("medium").alias("difficulty"))
    return merged_evidence(q.join(docs, "p_partkey"))


@query(r"""WITH e AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_nationkey AS q, (c_custkey % 101) / 100e0 AS s, c_custkey % 3 <> 0 AS o, c_nationkey % 4 <> 0 AS c, c_custkey % 5 // 4 AS w FROM customer),
a AS (SELECT count(*) AS n, sum(s) AS s, count(*) FILTER (o) AS o, count(*) FILTER (c) AS c, CAST(sum(w) AS BIGINT) AS w FROM e),
h AS (SELECT unnest(['# Validation report', '', '## Executive Summary', '', '| Metric | Score |', '| --- | --- |', '| **Total Detected Questions** | **' || n || '** |', '| **Average Stem Match Similarity** | **' || printf('%.2f', s * 100 / n) || '%** |', '| **Option Count Alignment Rate** | **' || printf('%.2f', o * 100e0 / n) || '%** |',
 '| **Classification Match** | **' || printf('%.2f', c * 100e0 / n) || '%** |', '| **Total Warnings** | **' || w || '** |', '', '## Comparison', '', '| Q# | Number | Stem Match % | Option Match | Class Match | Status |', '| --- | --- | --- | --- | --- | --- |']) AS line, unnest(range(16)) AS place FROM a)
SELECT place, line FROM h UNION ALL SELECT i + 16, '| ' || i || ' | ' || coalesce(CAST(nullif(q, 7) AS VARCHAR), 'N/A') || ' | ' || CAST(floor(s * 100 + 0.5) AS INT) || '% | ' || CASE WHEN o THEN 'yes' ELSE 'no' END || ' | ' || CASE WHEN c THEN 'yes' ELSE 'no' END || ' | ' || CASE WHEN o AND c AND w = 0 THEN 'Success' ELSE 'Review' END || ' |' FROM e""")
def validation_report(t) -> DataFrame:
    """A report as lines, one evaluation a customer."""
    k = F.col("c_custkey")
    e = numbered(t("customer").select("c_custkey", "c_nationkey"), "c_custkey").select("index", F.nullif("c_nationkey", F.lit(7)).alias("qnum"), ((k % 101) / 100.0).alias("similarity"), (k % 3 != 0).alias("options_match"), (F.col("c_nationkey") % 4 != 0).alias("class_match"), F.floor((k % 5) / 4).alias("warnings"))
    return report(e)
