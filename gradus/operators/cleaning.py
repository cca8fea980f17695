"""Cleaning of pasted pages, blocks of tagged papers, and selection of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as clean
from ..functions import intake as read
from .registry import query


@query(f"SELECT c_custkey, c_name || ' a b' || chr(10) || chr(10) || c_mktsegment AS said FROM customer")
def plain_clean(t) -> DataFrame:
    """Hard spaces, characters without width, blank runs and line ends of other systems are put right."""
    c = F.concat(F.lit(" \u200b"), "c_name", F.lit("\u00a0 a\u00ad\t b \r\n\r\n\n\n "), "c_mktsegment", F.lit("\ufeff  "))
    return t("customer").select("c_custkey", clean.plain(c).alias("said"))


@query("SELECT p_partkey, '<p>' || p_name || '</p><b>' || p_type || '</b>' AS html FROM part")
def office_clean(t) -> DataFrame:
    """Pages of word processors without their own tags, comments, styles and attributes."""
    c = F.concat(F.lit("<!--[if mso]><xml><w:x/></xml><![endif]--><style>p{}</style><p class=MsoNormal style='a:b'>"), "p_name", F.lit('<o:p></o:p></p><span lang="EN"> </span><span><b>'), "p_type", F.lit("</b></span><meta x>"))
    return t("part").select("p_partkey", clean.office_html(c).alias("html"))


@query("SELECT p_partkey, p_name || ' & co' || chr(10) || chr(10) || '* ' || p_brand || chr(10) || chr(10) || '* x' || chr(10) || chr(10) || p_type || ' | ' || p_size AS said, 'a.png,/' || p_partkey || '.jpg' AS images, p_type || ',' || p_size AS cells FROM part")
def html_blocks(t) -> DataFrame:
    """Text of a page with its lists and tables, the sources of images, and the cells."""
    c = F.concat(F.lit("<p><img src='a.png'>"), "p_name", F.lit(" &amp; co</p><ul><li>"), "p_brand", F.lit("</li><li>x</li></ul><table><tr><td>"), "p_type", F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit('</td></tr></table><IMG alt="b" src="/'), F.col("p_partkey").cast("string"), F.lit('.jpg">'))
    return t("part").select("p_partkey", clean.html_text(c).alias("said"), F.array_join(clean.images(c), ",").alias("images"), F.array_join(clean.cells(c), ",").alias("cells"))


@query("SELECT p_partkey, CAST(n AS BIGINT) AS n, CASE n WHEN 1 THEN '<p>1. ' || p_name || ' and more words</p>' WHEN 2 THEN '<p><b>Q2)</b> ' || p_type || ' with some words</p><p>more</p>' END AS segment FROM part, (VALUES (1), (2)) AS v(n)")
def html_segments(t) -> DataFrame:
    """Parts of a page that begin with a question's number; short ones are left out."""
    c = F.concat(F.lit("<p>1. "), "p_name", F.lit(" and more words</p><p>3. no</p><p><b>Q2)</b> "), "p_type", F.lit(" with some words</p><p>more</p>"))
    p = t("part").select("p_partkey", F.posexplode(clean.segments(c)).alias("n", "segment"))
    return p.select("p_partkey", (F.col("n") + 1).cast("bigint").alias("n"), "segment")


@query("SELECT p_partkey, 'text:' || p_name || ' |math:x^' || p_size || '|text: and |math:y|text: end' AS parts FROM part")
def content_parts(t) -> DataFrame:
    """Text and formulas of a question in turn."""
    c = F.concat("p_name", F.lit(" $x^"), F.col("p_size").cast("string"), F.lit("$ and $$y$$ end"))
    return t("part").select("p_partkey", F.array_join(F.transform(clean.parts(c), lambda x: F.concat_ws(":", x["kind"], x["said"])), "|").alias("parts"))


_ODD = {0: ("ok text (a[b]{c})", "a,b", ""), 1: ("open (a[b) text", "a,b", "brackets"), 2: ("one $ only", "a", "dollars,one_option"), 3: ("abc", "a,,b", "short,empty_option"), 4: ("~begin{tikz} here", "", "environment,empty_option,one_option"), 5: ("~begin{matrix} here)", "x,y", "brackets")}
_ODD_SQL = ", ".join(f"({k}, '{o}', {1 - 0.15 * len([x for x in o.split(',') if x]):.2f}e0)" for k, (_, _, o) in _ODD.items())


@query(f"SELECT p_partkey, odd, c AS confidence FROM part JOIN (VALUES {_ODD_SQL}) AS v(k, o, c) ON p_partkey % 6 = k, LATERAL (SELECT CASE o WHEN 'environment,empty_option,one_option' THEN 'empty_option,one_option,environment' ELSE o END AS odd)")
def structure_checks(t) -> DataFrame:
    """What is odd about a question, and the confidence that is left; the SQL states what each gives."""
    kinds = t("part").sparkSession.createDataFrame([(k, stem.replace("~", "\\"), options.split(",")) for k, (stem, options, _) in _ODD.items()], "k bigint, stem string, options array<string>")
    p = t("part").select("p_partkey", (F.col("p_partkey") % 6).alias("k")).join(F.broadcast(kinds), "k")
    p = p.select("p_partkey", clean.oddities(F.col("stem"), F.col("options")).alias("o"))
    return p.select("p_partkey", F.array_join("o", ",").alias("odd"), clean.confidence(F.col("o")).alias("confidence"))


@query("SELECT event_id, ['pdf', 'docx', 'image', 'text', 'html', 'unknown'][CAST(event_id % 6 AS INT) + 1] AS kind FROM events")
def file_kinds(t) -> DataFrame:
    """Kind of an upload by its first bytes and its name."""
    files = [("a.bin", "%PDF-1.7"), ("b.DOCX", "PK.."), ("c.jpeg", ".."), ("d.txt", "text"), ("e", "<html>"), ("f.exe", "MZ")]
    name, head = (F.get(F.array(*(F.lit(x[i]) for x in files)), (F.col("event_id") % 6).cast("int")) for i in (0, 1))
    return t("events").select("event_id", clean.file_kind(name, head).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'html' WHEN doc_id % 3 = 1 THEN 'plain' WHEN doc_id % 2 = 0 THEN 'ocr' END AS source FROM documents")
def clipboard_source(t) -> DataFrame:
    """The best of what a paste offers: HTML, else plain text, else recognised text."""
    k = F.col("doc_id")
    offered = F.array(F.when(k % 3 == 0, "html"), F.when(k % 3 <= 1, "plain"), F.when(k % 2 == 0, "ocr"))
    return t("documents").select("doc_id", F.get(F.array_compact(offered), 0).alias("source"))


TAG = r"^\[([a-zA-Z0-9_-]+)(?::\s*([^\]]*))?\]$"


def tagged_blocks(papers: DataFrame) -> DataFrame:
    """Blocks of papers (id, body) between [Question_start] and [Question_end].

    id, block (from 1), number, stem, options (label:text by bars), explanation, tags.  Lines
    after [Solution] explain; other tags are kept; options begin at their markers, and lines
    after them go on with the last one.  Text outside the marks is left out.
    """
    l = papers.select("id", F.posexplode(F.split(F.regexp_replace("body", r"\r\n", "\n"), "\n")).alias("pos", "line"))
    l = l.withColumn("line", F.trim("line")).withColumn("tag", F.lower(F.regexp_extract("line", TAG, 1)))
    w = Window.partitionBy("id").orderBy("pos")
    mode = F.last(F.when(F.col("tag").isin("question_start", "solution", "question_end"), F.col("tag")), ignorenulls=True).over(w)
    l = l.withColumns({"block": F.count_if(F.col("tag") == "question_start").over(w), "mode": mode})
    l = l.where("block > 0 and mode <> 'question_end' and line <> '' and tag not in ('question_start', 'solution')")
    inside = Window.partitionBy("id", "block").orderBy("pos")
    asked = (F.col("mode") == "question_start") & (F.col("tag") == "")
    l = l.withColumn("option", F.count_if(asked & read.is_option(F.col("line"))).over(inside))
    kind = F.when(F.col("tag") != "", "tag").when(F.col("mode") == "solution", "explanation").when(F.col("option") > 0, "option").otherwise("stem")
    tag = F.concat_ws(":", "tag", F.nullif(F.trim(F.regexp_extract("line", TAG, 2)), F.lit("")))
    said = F.when(F.col("tag") != "", tag).when((F.col("option") > 0) & asked & read.is_option(F.col("line")), F.concat_ws(":", read.option_label(F.col("line")), read.option_text(F.col("line")))).otherwise(F.col("line"))
    l = l.select("id", "block", "pos", "option", kind.alias("kind"), said.alias("said"))
    g = l.groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "option", "said"))).alias("lines"))
    of = lambda kind: F.transform(F.filter("lines", lambda x: x["kind"] == kind), lambda x: x["said"])
    options = F.aggregate(F.filter("lines", lambda x: x["kind"] == "option"), F.struct(F.lit("").alias("said"), F.lit(0).cast("bigint").alias("option")), lambda a, x: F.struct(F.concat(a["said"], F.when(a["said"] == "", "").when(a["option"] == x["option"], " ").otherwise("|"), x["said"]).alias("said"), x["option"].alias("option")), lambda a: a["said"])
    stem = F.array_join(of("stem"), "\n")
    return g.select("id", "block", F.regexp_extract(stem, read.TAGGED_NUMBER, 1).try_cast("int").alias("number"), F.regexp_replace(stem, read.TAGGED_NUMBER, "").alias("stem"), options.alias("options"), F.array_join(of("explanation"), "\n").alias("explanation"), F.array_join(of("tag"), ",").alias("tags"))


@query("""SELECT p_partkey AS id, CAST(n AS BIGINT) AS block, CASE n WHEN 1 THEN CAST(p_partkey % 90 + 1 AS INT) END AS number, CASE n WHEN 1 THEN 'What is ' || p_name || '?' || chr(10) || 'Say why.' ELSE 'Explain ' || p_type END AS stem,
 CASE n WHEN 1 THEN 'a:one and|b:two goes on here|c:three' ELSE '' END AS options, CASE n WHEN 1 THEN 'It is so.' || chr(10) || 'Always.' ELSE '' END AS explanation, CASE n WHEN 1 THEN 'type:MCQ,class:' || p_size ELSE 'hard' END AS tags FROM part, (VALUES (1), (2)) AS v(n)""")
def tagged_paper(t) -> DataFrame:
    """Question blocks of papers with tags."""
    k = F.col("p_partkey")
    body = F.concat(
        F.lit("Title\n[Question_start]\n[type: MCQ]\n[class:"), F.col("p_size").cast("string"), F.lit("]\nQ"), (k % 90 + 1).cast("string"), F.lit(". What is "), "p_name", F.lit("?\nSay why.\nA) one and\n(b) two\n  goes on here\nC: three\n[Solution]\nIt is so.\nAlways.\n[Question_end]\nbetween\r\n[question_START]\nExplain "),
        "p_type", F.lit("\n[hard]\n[Question_end]\nafter"),
    )
    return tagged_blocks(t("part").select(k.alias("id"), body.alias("body")))


def plain_blocks(papers: DataFrame) -> DataFrame:
    """Blocks of papers without tags (id, body): id, block, section, number, stem, options, passage.

    A header or a question's number opens a block; blocks without lines are left out.  Option
    lines with one marker are options, and lines after them go on with the last one.  What stands
    between the header of a comprehension section and its first question is that one's passage.
    """
    l = papers.select("id", F.posexplode(F.split(F.regexp_replace("body", r"\r\n", "\n"), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    line = F.col("line")
    header = read.section_name(line)
    start = header.isNull() & line.rlike(read.NUMBER)
    option = header.isNull() & ~start & read.is_option(line) & (F.size(F.array_distinct(read.marker_labels(line))) < 2)
    w = Window.partitionBy("id").orderBy("pos")
    l = l.withColumns({"header": header, "start": start, "is_option": option})
    l = l.withColumns({"block": F.count_if(F.col("header").isNotNull() | F.col("start")).over(w), "section": F.coalesce(F.last("header", ignorenulls=True).over(w), F.lit("General"))})
    inside = Window.partitionBy("id", "block").orderBy("pos")
    l = l.withColumns({"option": F.count_if("is_option").over(inside), "opened": F.max("start").over(inside)}).where("header is null")
    said = F.when(F.col("start"), F.regexp_replace("line", read.NUMBER, "")).when(F.col("is_option"), F.concat_ws(":", read.option_label(line), read.option_text(line))).otherwise(line)
    number = F.when(F.col("start"), F.concat(F.regexp_extract("line", read.NUMBER, 1), F.regexp_extract("line", read.NUMBER, 2)).try_cast("int"))
    passage = ~F.col("opened") & F.lower("section").rlike("comprehension|passage") & (F.col("option") == 0)
    l = l.select("id", "block", "section", "pos", "option", number.alias("number"), passage.alias("passage"), said.alias("said"))
    g = l.groupBy("id", "block", "section").agg(F.max("number").alias("number"), F.array_sort(F.collect_list(F.struct("pos", "option", "passage", "said"))).alias("lines"))
    of = lambda keep: F.array_join(F.transform(F.filter("lines", keep), lambda x: x["said"]), "\n")
    options = F.aggregate(F.filter("lines", lambda x: x["option"] > 0), F.struct(F.lit("").alias("said"), F.lit(0).cast("bigint").alias("option")), lambda a, x: F.struct(F.concat(a["said"], F.when(a["said"] == "", "").when(a["option"] == x["option"], " ").otherwise("|"), x["said"]).alias("said"), x["option"].alias("option")), lambda a: a["said"])
    g = g.select("id", "block", "section", "number", of(lambda x: (x["option"] == 0) & ~x["passage"]).alias("stem"), options.alias("options"), of(lambda x: x["passage"]).alias("own"))
    before = F.lag(F.struct("section", "own")).over(Window.partitionBy("id").orderBy("block"))
    g = g.withColumn("before", before)
    passage = F.when(F.col("before.section") == F.col("section"), F.nullif(F.col("before.own"), F.lit("")))
    return g.withColumn("passage", passage).where("stem <> '' or options <> ''").select("id", "block", "section", "number", "stem", "options", "passage")


@query("""SELECT p_partkey AS id, CAST(b AS BIGINT) AS block, s AS section, CAST(n AS INT) AS number, replace(stem, '#', p_name) AS stem, options, replace(passage, '#', p_name) AS passage FROM part, (VALUES
 (0, 'General', NULL, 'About # here', '', NULL), (1, 'General', 1, 'What is #?' || chr(10) || 'Say it.', 'a:one and on|b:two', NULL), (2, 'General', 2, 'Which (a) x or (b) y?', '', NULL), (5, 'Comprehension', 12, 'Who ran?', '', 'A story of a # is told.' || chr(10) || 'It is long.'), (6, 'Comprehension', 13, 'Why?', 'a:so', NULL)) AS v(b, s, n, stem, options, passage)""")
def plain_paper(t) -> DataFrame:
    """Question blocks of papers without tags; the SQL states what each paper must give."""
    body = F.concat(F.lit("About "), "p_name", F.lit(" here\n1. What is "), "p_name", F.lit("?\nSay it.\n\nA: one\nand on\nB: two\r\nQ2) Which (a) x or (b) y?\nSection B\nComprehension\nA story of a "), "p_name", F.lit(" is told.\nIt is long.\n(12) Who ran?\nQuestion 13: Why?\nA: so"))
    return plain_blocks(t("part").select(F.col("p_partkey").alias("id"), body.alias("body")))


def candidates(pool: DataFrame, specs: list[tuple[str, int, list[str]]]) -> DataFrame:
    """All questions that a paper can take: section, list, place, id, key.

    Two lists a section: by difficulty, and by chapter, each without repeated keys and in order of
    (h, id).  A paper of n questions has n keys at most, so the first 2 n places of a list hold all
    that can be taken from it, whatever other sections took before.
    """
    n = sum(count for _, count, _ in specs)
    of = pool.sparkSession.createDataFrame([(name, c) for name, _, chapters in specs for c in chapters], "section string, of_chapter string")
    mine = pool.join(F.broadcast(of), F.col("chapter") == F.col("of_chapter")).drop("of_chapter")
    every = []
    for kind, scope in (("difficulty", ["section", "difficulty", "key"]), ("chapter", ["section", "key"])):
        once = mine.withColumn("copy", F.row_number().over(Window.partitionBy(*scope).orderBy("h", "id"))).where("copy = 1")
        place = F.row_number().over(Window.partitionBy("section", kind).orderBy("h", "id"))
        every.append(once.withColumn("place", place).where(F.col("place") <= 2 * n).select("section", F.lit(kind).alias("kind"), F.col(kind).alias("list"), "place", "id", "key", "h"))
    return every[0].union(every[1])


def chosen(pool: DataFrame, specs: list[tuple[str, int, list[str]]]) -> DataFrame:
    """Questions for the sections of a paper: section, id, place.

    pool: id, chapter, difficulty, key (of duplicates), h (a seeded order).  specs: name, count
    and chapters of each section.  A section takes its quotas of easy, medium and hard questions,
    then fills up from its chapters in turn; no id or key is used twice in the paper.  One job
    finds the candidates, as few as the specs say; the driver deals them out.
    """
    lists: dict[tuple, list] = {}
    for r in sorted(candidates(pool, specs).collect(), key=lambda r: r["place"]):
        lists.setdefault((r["section"], r["kind"], r["list"]), []).append(r)
    used: set = set()
    paper: list[tuple] = []

    def take(rows: list, n: int) -> list:
        out = [r for r in rows if r["key"] not in used][:n]
        used.update(r["key"] for r in out)
        return out

    for name, count, _ in specs:
        easy, medium = int(count * 0.3 + 0.5), int(count * 0.5 + 0.5)
        got = []
        for level, n in (("easy", easy), ("medium", medium), ("hard", max(0, count - easy - medium))):
            got += take(lists.get((name, "difficulty", level), []), n)
        chapters = [[(i, c, r) for i, r in enumerate(r for r in rows if r["key"] not in used)] for (s, kind, c), rows in lists.items() if s == name and kind == "chapter"]
        in_turn = sorted((x for rows in chapters for x in rows), key=lambda x: x[:2])
        got += take([r for *_, r in in_turn], count - len(got))
        paper += [(name, r["id"], i + 1) for i, r in enumerate(got)]
    return pool.sparkSession.createDataFrame(paper, "section string, id bigint, place bigint")


_POOL = "SELECT p_partkey AS id, p_type AS chapter, CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 48 THEN 'medium' ELSE 'hard' END AS difficulty, p_name || p_type AS key, md5(CAST(p_partkey AS VARCHAR) || '-sel') AS h FROM part WHERE p_size < 49 OR p_type = 'PROMO'"


def _sections_sql() -> str:
    ctes, used, out = [f"p AS ({_POOL})"], [], []
    for s, (name, count, chapters) in enumerate(_SPECS):
        mine = "chapter IN (" + ", ".join(f"'{c}'" for c in chapters) + ")"
        for step, (level, n) in enumerate((("easy", 6), ("medium", 10), ("hard", 4))):
            gone = " AND ".join(f"key NOT IN (SELECT key FROM {u})" for u in used) or "true"
            ctes.append(f"s{s}{step} AS (SELECT id, key, {step} AS step, h AS o FROM (SELECT * FROM p WHERE {mine} AND difficulty = '{level}' AND {gone} QUALIFY row_number() OVER (PARTITION BY key ORDER BY h, id) = 1) ORDER BY h, id LIMIT {n})")
            used.append(f"s{s}{step}")
        gone = " AND ".join(f"key NOT IN (SELECT key FROM {u})" for u in used)
        have = " + ".join(f"(SELECT count(*) FROM s{s}{i})" for i in range(3))
        ctes.append(f"f{s} AS (SELECT id, key, 3 AS step, lpad(CAST(r AS VARCHAR), 9, '0') || '-' || chapter AS o, row_number() OVER (ORDER BY r, chapter) AS n FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY h, id) AS r FROM (SELECT * FROM p WHERE {mine} AND {gone} QUALIFY row_number() OVER (PARTITION BY key ORDER BY h, id) = 1)))")
        ctes.append(f"s{s}3 AS (SELECT id, key, step, o FROM f{s} WHERE n <= {count} - ({have}))")
        used.append(f"s{s}3")
        out += [f"SELECT '{name}' AS section, id, step, o FROM s{s}{i}" for i in range(4)]
    return f"WITH {', '.join(ctes)} SELECT section, id, CAST(row_number() OVER (PARTITION BY section ORDER BY step, o, id) AS BIGINT) AS place FROM ({' UNION ALL '.join(out)})"


_SPECS = [("A", 20, ["ECONOMY", "PROMO"]), ("B", 20, ["PROMO", "STANDARD", "SMALL"]), ("C", 20, ["SMALL"])]


@query(_sections_sql())
def paper_selection(t) -> DataFrame:
    """A paper of three sections from one pool."""
    size = F.col("p_size")
    level = F.when(size <= 15, "easy").when(size <= 48, "medium").otherwise("hard")
    p = t("part").where((size < 49) | (F.col("p_type") == "PROMO"))
    pool = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("chapter"), level.alias("difficulty"), F.concat("p_name", "p_type").alias("key"), F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-sel"))).alias("h"))
    return chosen(pool, _SPECS)


_MATHS = {0: ("frac12 and sqrtx of ½", r"\frac{1}{2} and \sqrt{x} of \frac{1}{2}", ""), 1: (r"\frac{a} and \sqrt(y+1) {x", r"\frac{a} and \sqrt{y+1} {x}", "fraction"), 2: ("P(A and frac{1}{2} $", r"P(A and \frac{1}{2} $", "probability,dollars"), 3: (r"\fracab } done", r"{\frac{a}{b} } done", ""), 4: ("fraction and sqrtxy", "fraction and sqrtxy", "")}
_MATHS_SQL = ", ".join(f"({k}, '{a}', '{b}')" for k, (_, a, b) in _MATHS.items())


@query(f"SELECT p_partkey, said, wrong FROM part JOIN (VALUES {_MATHS_SQL}) AS v(k, said, wrong) ON p_partkey % 5 = k")
def prepared_maths(t) -> DataFrame:
    """Formulas written in full with their braces closed, and what is still wrong; the SQL states what each gives."""
    kinds = t("part").sparkSession.createDataFrame([(k, raw) for k, (raw, _, _) in _MATHS.items()], "k bigint, raw string")
    p = t("part").select("p_partkey", (F.col("p_partkey") % 5).alias("k")).join(F.broadcast(kinds), "k")
    p = p.select("p_partkey", clean.prepared_math(F.col("raw")).alias("m"))
    return p.select("p_partkey", clean.closed_braces(F.col("m")).alias("said"), F.array_join(clean.malformed(F.col("m")), ",").alias("wrong"))


@query("SELECT p_partkey, 'A long line that goes on ' || p_name || ' and' || chr(10) || '(a) one' || chr(10) || '1. ' || p_type || ' is of more.' || chr(10) || 'Next , then' AS said FROM part")
def merged_lines(t) -> DataFrame:
    """Lines that go on with the one before, in order of the merged text."""
    c = F.concat(F.lit("A long line\ngoes on\n"), "p_name", F.lit(" and\n(a) one\n1. "), "p_type", F.lit(" is of\nmore.\nNext\n, then\n"))
    return t("part").select("p_partkey", clean.merged_lines(F.replace(c, F.lit("line\ngoes"), F.lit("line that\ngoes"))).alias("said"))


@query("SELECT p_partkey, p_name || ' [FIGURE_0] and [FIGURE_1] end' AS said, 'data:image/png;base64,AA' || p_partkey || '=,data:image/gif;base64,Bz+/' AS data FROM part")
def isolated_figures(t) -> DataFrame:
    """Embedded images out of the text, in order."""
    c = F.concat("p_name", F.lit(' <img alt="x" src="data:image/png;base64,AA'), F.col("p_partkey").cast("string"), F.lit('="/> and data:image/gif;base64,Bz+/ end'))
    text, data = clean.isolated_figures(c)
    return t("part").select("p_partkey", text.alias("said"), F.array_join(data, ",").alias("data"))


@query("""SELECT p_brand AS paper, '<h1>' || p_brand || '</h1><ol>' || string_agg('<li>' || p_name || ' (' || (p_size % 4 + 1) || ')</li>', '' ORDER BY p_partkey) || '</ol>' AS html, string_agg(chr(CAST(65 + p_partkey % 4 AS INT)), ' ' ORDER BY p_partkey) AS key, CAST(sum(p_size % 4 + 1) AS BIGINT) AS marks
FROM part WHERE p_brand <> 'Brand#3' GROUP BY p_brand""")
def paper_export(t) -> DataFrame:
    """Papers as HTML with their answer keys; drafts are left out."""
    marks = F.col("p_size") % 4 + 1
    item = F.concat(F.lit("<li>"), read.html_escaped(F.col("p_name")), F.lit(" ("), marks.cast("string"), F.lit(")</li>"))
    p = t("part").where("p_brand <> 'Brand#3'").select("p_brand", "p_partkey", item.alias("item"), F.chr(65 + F.col("p_partkey") % 4).alias("letter"), marks.alias("marks"))
    p = p.groupBy(F.col("p_brand").alias("paper")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item", "letter"))).alias("q"), F.sum("marks").cast("bigint").alias("marks"))
    html = F.concat(F.lit("<h1>"), read.html_escaped(F.col("paper")), F.lit("</h1><ol>"), F.array_join(F.transform("q", lambda x: x["item"]), ""), F.lit("</ol>"))
    return p.select("paper", html.alias("html"), F.array_join(F.transform("q", lambda x: x["letter"]), " ").alias("key"), "marks")


@query("""WITH gone AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 100 = 0),
free AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS n FROM part WHERE p_partkey % 10 <> 0)
SELECT gone.p_partkey AS replaced, free.p_partkey AS by_question FROM gone LEFT JOIN free USING (p_type, n)""")
def replaced_questions(t) -> DataFrame:
    """Other questions of the chapter for those that go, each its own; those in use are left out.
    Where a chapter has too few, the last get none."""
    nth = lambda *order: F.row_number().over(Window.partitionBy("p_type").orderBy(*order))
    p = t("part").select("p_partkey", "p_type", F.md5(F.col("p_partkey").cast("string")).alias("h"))
    gone = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("replaced"), "p_type", nth("p_partkey").alias("n"))
    free = p.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("by_question"), "p_type", nth("h", "p_partkey").alias("n"))
    return gone.join(free, ["p_type", "n"], "left").select("replaced", "by_question")


@query("SELECT s_suppkey AS slot, coalesce(n_nationkey, -1) AS question, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 9 END, n_regionkey, 4) AS marks FROM supplier LEFT JOIN nation ON s_suppkey = n_nationkey * 2")
def applied_selection(t) -> DataFrame:
    """Chosen questions put into the places of a paper, which keep their own marks."""
    n = t("nation").select((F.col("n_nationkey") * 2).alias("at"), F.col("n_nationkey").alias("question"), "n_regionkey")
    s = t("supplier").select(F.col("s_suppkey").alias("slot")).join(n, F.col("slot") == F.col("at"), "left")
    return s.select("slot", F.coalesce("question", F.lit(-1)).alias("question"), F.coalesce(F.when(F.col("slot") % 3 == 0, 9), "n_regionkey", F.lit(4)).alias("marks"))
