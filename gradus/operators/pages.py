"""Cleaning and checks over whole texts and pages; their SQL computes the same from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as clean
from ..functions import intake as read
from .registry import query


def _g(c: str, *steps: tuple[str, str]) -> str:
    """A chain of replacements in SQL, by patterns without look-around."""
    for pattern, to in steps:
        quoted = pattern.replace("'", "''")
        c = f"regexp_replace({c}, '{quoted}', {to if to.startswith('chr') else repr(to)}, 'g')"
    return c


_PLAIN = (clean.NO_WIDTH, ""), ("[\u00a0\u2007\u202f]", " "), (r"\r\n?", "chr(10)"), (r"[ \t]+", " "), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "")


@query(f"SELECT doc_id, {_g('text', *_PLAIN)} AS said FROM documents")
def documents_plain(t) -> DataFrame:
    """Texts without odd spaces and blank runs."""
    return t("documents").select("doc_id", clean.plain(F.col("text")).alias("said"))


_OFFICE = (clean.OFFICE, ""), (clean.OFFICE_ATTRIBUTES, ""), (r"(?i)<span\s*>\s*</span\s*>", ""), (r"(?i)</?span\s*>|</?font\b[^>]*>", "")


@query(f"SELECT page_id, trim({_g('html', *_OFFICE)}, ' ') AS html FROM pages")
def pages_cleaned(t) -> DataFrame:
    """Pages without comments, styles, scripts, heads and the attributes of word processors."""
    return t("pages").select("page_id", clean.office_html(F.col("html")).alias("html"))


def _unescaped(c: str) -> str:
    for name, char in sorted(read.ENTITIES.items(), key=lambda e: e[0] == "amp"):
        c = f"replace({c}, '&{name};', chr({ord(char)}))"
    return c


_TEXT = (r"(?i)<(?:style|script)\b[\s\S]*?</(?:style|script)\s*>", ""), (r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | "), (r"(?i)<li\b[^>]*>", "chr(10) || '* '"), (r"(?i)<br\s*/?>|</(?:p|div|tr|h[1-6]|li|ul|ol|table)\s*>", "chr(10)"), (r"<[^>]+>", "")


@query(f"SELECT page_id, {_g(_unescaped(_g('html', *_TEXT)), *_PLAIN)} AS said FROM pages")
def pages_text(t) -> DataFrame:
    """The text of whole pages: cells, items and blocks apart."""
    return t("pages").select("page_id", clean.html_text(F.col("html")).alias("said"))


@query(r"""WITH s AS (SELECT page_id, unnest(string_split(regexp_replace(html, '(?i)<p\b', chr(1) || '<p', 'g'), chr(1))) AS part FROM pages)
SELECT page_id, count(*) AS n, CAST(sum(length(part)) AS BIGINT) AS chars FROM s GROUP BY page_id""")
def page_parts(t) -> DataFrame:
    """Parts of pages before each paragraph, and their lengths."""
    parts = F.split(F.regexp_replace("html", r"(?i)<p\b", "\x01<p"), "\x01", -1)
    return t("pages").select("page_id", F.size(parts).cast("bigint").alias("n"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"))


_FORMULA = r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$"


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{_FORMULA}')) AS formulas, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '{_FORMULA}'), lambda x: length(regexp_replace(x, '^\$+|\$+$', '', 'g')))), 0) AS BIGINT) AS formula_chars,
 coalesce(array_to_string(list_filter(regexp_split_to_array(text, '{_FORMULA}'), lambda x: x <> ''), '|'), '') AS texts FROM documents""")
def document_parts(t) -> DataFrame:
    """Formulas of texts, and what stands between them."""
    kinds = t("documents").select("doc_id", F.explode(F.array(clean.parts(F.col("text")))).alias("p"))
    of = lambda kind: F.transform(F.filter("p", lambda x: x["kind"] == kind), lambda x: x["said"])
    return kinds.select("doc_id", F.size(of("math")).cast("bigint").alias("formulas"), F.aggregate(of("math"), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("formula_chars"), F.array_join(of("text"), "|").alias("texts"))


def _emptied(c: str, times: int) -> str:
    for _ in range(times):
        c = f"regexp_replace({c}, '\\(\\)|\\[\\]|\\{{\\}}', '', 'g')"
    return c


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS s, regexp_replace(coalesce(text, ''), '[^()\[\]{{}}]', '', 'g') AS b FROM documents),
r AS (SELECT doc_id, s, {_emptied('b', 12)} AS b FROM d)
SELECT doc_id, list_filter(['brackets', 'dollars', 'short', 'empty_option', 'one_option', 'environment'], lambda x: (x = 'brackets' AND b <> '') OR (x = 'dollars' AND (length(s) - length(replace(s, '$', ''))) % 2 = 1) OR (x = 'short' AND length(trim(s, ' ')) < 5) OR (x = 'empty_option' AND doc_id % 3 = 0) OR (x = 'one_option' AND doc_id % 3 = 1)
 OR (x = 'environment' AND len(list_filter(regexp_extract_all(s, '\\begin\{{([a-z]+)\}}', 1), lambda e: NOT regexp_matches(e, '^(matrix|pmatrix|bmatrix|cases|aligned|array)'))) > 0)) AS odd FROM r""")
def document_checks(t) -> DataFrame:
    """What is odd about each document as a question, with none, one or two options."""
    options = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return t("documents").select("doc_id", clean.oddities(F.coalesce("text", F.lit("")), options).alias("odd"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\.(png|jpe?g|webp)$') THEN 'image' WHEN regexp_matches(url, '(?i)\.(txt|md)$') THEN 'text' WHEN regexp_matches(url, '(?i)\.html?$') OR starts_with(html, '<') THEN 'html' ELSE 'unknown' END AS kind FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.PNG' WHEN 1 THEN url || '.md' ELSE url END AS url, CASE WHEN page_id % 5 IN (3, 4) THEN substr(html, 1 + CAST(page_id % 2 AS INT) * 20) ELSE html END AS html FROM pages)""")
def page_kinds(t) -> DataFrame:
    """Kinds of pages by their address and first characters."""
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat("url", F.lit(".PNG"))).when(k == 1, F.concat("url", F.lit(".md"))).otherwise(F.col("url"))
    head = F.when(k >= 3, F.substring("html", 1 + (F.col("page_id") % 2).cast("int") * 20, F.lit(16))).otherwise(F.substring("html", 1, 16))
    return t("pages").select("page_id", clean.file_kind(name, head).alias("kind"))


@query(r"""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE html END AS html, CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE text END AS plain, item FROM documents LEFT JOIN pages ON doc_id = page_id LEFT JOIN (SELECT item_id, text AS item FROM benchmark) ON doc_id = item_id)
SELECT doc_id, CASE WHEN regexp_matches(html, '\S') THEN 'html' WHEN regexp_matches(plain, '\S') THEN 'plain' WHEN regexp_matches(item, '\S') THEN 'ocr' END AS source,
 length(CASE WHEN regexp_matches(html, '\S') THEN html WHEN regexp_matches(plain, '\S') THEN plain WHEN regexp_matches(item, '\S') THEN item END) AS chars FROM o""")
def paste_sources(t) -> DataFrame:
    """The best that a paste offers, by content: markup, else plain text, else recognised text, if not blank."""
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "\n").otherwise(F.col("text")).alias("plain"))
    d = d.join(t("pages").select(F.col("page_id").alias("doc_id"), "html"), "doc_id", "left").join(t("benchmark").select(F.col("item_id").cast("bigint").alias("doc_id"), F.col("text").alias("ocr")), "doc_id", "left")
    d = d.withColumn("html", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("html")))
    first = F.coalesce(*(F.when(F.col(c).rlike(r"\S"), F.struct(F.lit(c).alias("source"), F.length(c).cast("bigint").alias("chars"))) for c in ("html", "plain", "ocr")))
    return d.select("doc_id", first["source"].alias("source"), first["chars"].alias("chars"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, line FROM (SELECT doc_id, p, trim(ls[p], ' ') AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE line <> ''),
j AS (SELECT *, regexp_matches(line, '(?i)^(?:Q(?:uestion)?\s*)?\d{1,3}[).:\-\s]+|^\(\d{1,3}\)\s+') OR regexp_matches(line, '"""
       + read.OPTION_LINE
       + r"""') AS own, regexp_matches(line, '^[a-z]') OR regexp_matches(line, '^[,.;?]') AS more FROM l),
m AS (SELECT doc_id, i, line AS held, 1 AS block FROM j WHERE i = 1
 UNION ALL SELECT j.doc_id, j.i, CASE WHEN g THEN m.held || ' ' || j.line ELSE j.line END, m.block + CASE WHEN g THEN 0 ELSE 1 END FROM m JOIN j ON j.doc_id = m.doc_id AND j.i = m.i + 1, LATERAL (SELECT NOT j.own AND (j.more OR regexp_matches(m.held, '(?i)(?:\b(?:and|or|the|of|to|is|if|a|an|in|with|for)|[,=+\-])$') OR (length(m.held) < 55 AND NOT regexp_matches(m.held, '[.?!:;]$') AND NOT regexp_matches(m.held, '"""
       + read.OPTION_LINE
       + r"""'))) AS g)),
b AS (SELECT doc_id, block, arg_max(held, i) AS held FROM m GROUP BY ALL)
SELECT doc_id, string_agg(held, chr(10) ORDER BY block) AS said FROM b GROUP BY doc_id""")
def documents_merged(t) -> DataFrame:
    """Lines of texts that go on with the one before, of documents with any line."""
    d = t("documents").select("doc_id", F.explode(F.array(clean.merged_lines(F.col("text")))).alias("said"))
    return d.where("said <> ''")

