"""Pasted pages through all stages, what they are, and how far the result can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as clean
from ..functions.mathml import page_with_latex
from ..plans.stages import Stage, counts, failed, staged
from ..sources import markup
from .registry import query


def _text_only(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


#: From a paste to its text; formulas before markup is cleaned, as that drops their elements.
STAGES = [
    Stage("ingest", lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), lambda b, a: F.when(F.coalesce(a, F.lit("")) == "", "nothing pasted")),
    Stage("formulas", lambda c: page_with_latex(c), odd=lambda a: F.when(a.rlike(r"(?i)<math\b|<(?:m:)?oMath"), "formula left")),
    Stage("clean", clean.office_html),
    Stage("figures", lambda c: clean.isolated_figures(c)[0]),
    Stage("balance", lambda c: markup.repaired(c)["html"]),
    Stage("text", clean.html_text, lambda b, a: F.when(a == "", "no text")),
    Stage("check", lambda c: c, odd=lambda a: F.array_join(clean.malformed(a), ",")),
]


def _pastes(t) -> DataFrame:
    """Pages as pastes: some blank, some cut off, some with figures or formulas, some without text."""
    k, html = F.col("page_id") % 8, F.col("html")
    half = F.substring(html, F.lit(1), (F.length(html) / 2).cast("int"))
    paste = F.when(k == 0, "  \n ").when(k == 1, half).when(k == 2, F.concat(html, F.lit('<img alt=x src="data:image/png;base64,AAAA">'))).when(k == 3, F.concat(F.lit("<p>a<math><mi>x</mi></math>"), html)).when(k == 4, "<p><b></b> <br></p>").when(k == 5, F.concat(html, F.lit("<p>an open $ here</p><math><mi>"))).otherwise(html)
    return t("pages").select("page_id", paste.alias("html"))


@query(r"""WITH p AS (SELECT page_id % 8 AS k, html, count(*) OVER () AS n FROM pages),
s AS (SELECT *, length(html) - length(replace(html, '$', '')) AS own FROM (SELECT k, regexp_replace(regexp_replace(CASE WHEN k = 1 THEN substr(html, 1, length(html) // 2) ELSE html END, '(?is)<!--.*?-->|<(style|script|head)\b.*?</(style|script|head)\s*>', '', 'g'), '<[^>]*$', '') AS html FROM p)),
c AS (SELECT count(*) AS n, count(*) FILTER (k = 0) AS blank, count(*) FILTER (k = 4) AS textless, count(*) FILTER (k = 2) AS figures, count(*) FILTER (k = 3) AS maths, count(*) FILTER (k = 5) AS left_over FROM p)
SELECT CAST(0 AS INT) AS place, 'ingest' AS stage, n AS taken, n - blank AS passed, left_over AS degraded FROM (SELECT n, blank, 0 AS left_over FROM c)
UNION ALL SELECT 1, 'formulas', n - blank, n - blank, left_over FROM c UNION ALL SELECT 2, 'clean', n - blank, n - blank, 0 FROM c UNION ALL SELECT 3, 'figures', n - blank, n - blank, 0 FROM c UNION ALL SELECT 4, 'balance', n - blank, n - blank, 0 FROM c
UNION ALL SELECT 5, 'text', n - blank, n - blank - textless, 0 FROM c UNION ALL SELECT 6, 'check', n - blank - textless, n - blank - textless, (SELECT count(*) FROM s WHERE k NOT IN (0, 4) AND (own + CASE k WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END) % 2 = 1) FROM c""")
def paste_stages(t) -> DataFrame:
    """How many pastes each stage took, passed and found odd."""
    return counts(staged(_pastes(t), "html", STAGES)).drop("changed")


@query("SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'ingest' ELSE 'text' END AS stage, CASE WHEN page_id % 8 = 0 THEN 'nothing pasted' ELSE 'no text' END AS reason FROM pages WHERE page_id % 8 IN (0, 4)")
def pastes_set_aside(t) -> DataFrame:
    """Pastes that failed, with the stage and why."""
    s = staged(_pastes(t), "html", STAGES)
    return s.select("page_id", failed(s).alias("f")).where("f is not null").select("page_id", "f.stage", "f.reason")


# Marks of what a paste holds, in its markup and in its text.
FLAGS = {
    "omml": (r"xmlns:m=|xmlns:o=|<m:oMath|<oMath", None),
    "vml": (r"xmlns:v=|<v:shape|<v:imagedata", None),
    "ole": (r"o:OLEObject|ProgID=", None),
    "math_type": (r"Equation\.DSMT4|MathType", None),
    "wmf": (r"data:image/wmf|\.wmf\b", None),
    "images": (r"<img\b|data:image/|clip_image", r"\[FIGURE_"),
    "tables": (r"<table\b", r"\[TABLE\]"),
    "inline_equations": (None, r"\bMATHPLACEHOLDER\b|\$|\\\("),
    "office_artifacts": (r'mso-|urn:schemas-microsoft-com|ProgID="Word\.', None),
}
SCANNED, CLIP = "tesseract|ocr", "clip_image"
SHORT_TEXT = 100
# Marks of where a paste is from, the first that holds.
ORIGINS = (
    ("microsoft_word_html", r'xmlns:w="urn:schemas-microsoft-com:office:word"|ProgID="Word\.Document"', None),
    ("office_clipboard", "mso-|clip_image", None),
    ("google_docs_paste", 'docs\\.google\\.com|id="docs-internal-guid', None),
    ("browser_html", r"<[a-z][\s\S]*>", None),
    ("pdf_extract", "pdf", "pdf"),
    ("ocr_output", None, "ocr|tesseract"),
)


def fingerprint(html: Column, plain: Column) -> dict[str, Column]:
    """Eleven flags of a paste and where it is from; null markup and text are empty."""
    h, p = F.coalesce(html, F.lit("")), F.coalesce(plain, F.lit(""))
    has = lambda in_html, in_text: (h.rlike(f"(?i){in_html}") if in_html else F.lit(False)) | (p.rlike(f"(?i){in_text}") if in_text else F.lit(False))
    flags = {n: has(*marks) for n, marks in FLAGS.items()}
    flags["scanned_content"] = has(None, SCANNED) | flags["images"] & (F.length(p) < SHORT_TEXT)
    flags["rendered_equations"] = flags["wmf"] | flags["ole"] | has(CLIP, None)
    blank = lambda c: F.regexp_replace(c, r"\s", "") == ""
    source = F.coalesce(*(F.when(has(*marks), name) for name, *marks in ORIGINS), F.when(~blank(p) & blank(h), "plain_text"), F.lit("unknown"))
    return {"source_type": source, **flags}


@query(r"""WITH d AS (SELECT doc_id, text, CASE doc_id % 7 WHEN 0 THEN '<p xmlns:m="x"><m:oMath>' || source WHEN 1 THEN '<img src="a/clip_image1.wmf">' WHEN 2 THEN '<o:OLEObject ProgID="Equation.DSMT4"/>' WHEN 3 THEN '<b id="docs-internal-guid-1">' || lang || '<table>' WHEN 4 THEN NULL WHEN 5 THEN 'from a PDF' ELSE '<p style="mso-x:y">' END AS h FROM documents)
SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'office_clipboard' WHEN 3 THEN 'google_docs_paste' WHEN 4 THEN CASE WHEN regexp_matches(coalesce(text, ''), '(?i)pdf') THEN 'pdf_extract' WHEN regexp_matches(coalesce(text, ''), '(?i)ocr|tesseract') THEN 'ocr_output' WHEN regexp_matches(coalesce(text, ''), '\S') THEN 'plain_text' ELSE 'unknown' END WHEN 5 THEN 'pdf_extract' WHEN 6 THEN 'office_clipboard' ELSE 'browser_html' END AS source_type,
 doc_id % 7 = 0 AS omml, doc_id % 7 = 1 AS images_flag, doc_id % 7 = 2 AS ole, doc_id % 7 = 2 AS math_type, doc_id % 7 = 1 AS wmf, doc_id % 7 = 3 OR contains(coalesce(text, ''), '[TABLE]') AS tables, regexp_matches(coalesce(text, ''), '\$|\\\(') AS inline_equations, doc_id % 7 IN (1, 2) AS rendered_equations, doc_id % 7 = 6 AS office_artifacts,
 regexp_matches(coalesce(text, ''), '(?i)tesseract|ocr') OR (doc_id % 7 = 1 AND length(coalesce(text, '')) < 100) AS scanned_content, false AS vml FROM d""")
def paste_fingerprints(t) -> DataFrame:
    """What pastes hold and where they are from: texts of all documents with markup of several kinds."""
    k = F.col("doc_id") % 7
    html = [F.concat(F.lit('<p xmlns:m="x"><m:oMath>'), "source"), F.lit('<img src="a/clip_image1.wmf">'), F.lit('<o:OLEObject ProgID="Equation.DSMT4"/>'), F.concat(F.lit('<b id="docs-internal-guid-1">'), "lang", F.lit("<table>")), F.lit(None), F.lit("from a PDF"), F.lit('<p style="mso-x:y">')]
    of = fingerprint(F.coalesce(*(F.when(k == i, c) for i, c in enumerate(html))), F.col("text"))
    of["images_flag"] = of.pop("images")
    return t("documents").select("doc_id", *(c.alias(n) for n, c in of.items()))


def confidences(unresolved: Column, malformed: Column, unread: Column, kind: Column, options: Column, stem: Column, tags: Column, level: Column) -> dict[str, Column]:
    """How far a question can be trusted: math, semantic, metadata, fidelity, each 0.1 to 1.

    unresolved placeholders, malformed formulas, unread drawings and options are numbers; a
    choice without two options, or other than four, a short stem and missing tags or class cost.
    """
    less = lambda *costs: F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), sum((-c for c in costs), F.lit(1.0)))), 6)
    cost = lambda when, c: F.when(when, c).otherwise(0.0)
    choice = F.coalesce(kind.isin("MCQ_SINGLE", "MCQ_MULTI"), F.lit(False))
    few = F.when(choice & (options < 2), 0.4).when(choice & (options != 4), 0.1).otherwise(0.0)
    return {
        "math": less(unresolved * 0.25, malformed * 0.15, unread * 0.3),
        "semantic": less(cost(F.coalesce(kind, F.lit("DESCRIPTIVE")).isin("", "DESCRIPTIVE"), 0.1), few, cost(F.length(stem) < 20, 0.2)),
        "metadata": less(cost(tags == 0, 0.1), cost(F.coalesce(level, F.lit(0)) == 0, 0.2)),
        "fidelity": less(malformed * 0.1, unresolved * 0.15, unread * 0.25),
    }


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS u, p_size % 3 AS m, p_size % 5 AS d, [NULL, 'MCQ_SINGLE', 'MCQ_MULTI', 'DESCRIPTIVE', 'NUMERICAL'][1 + CAST(p_partkey % 5 AS INT)] AS kind, p_size % 6 AS o, p_name || p_type AS stem, p_partkey % 2 AS tags, p_size % 13 AS level FROM part)
SELECT p_partkey, round(greatest(0.1e0, 1 - u * 0.25e0 - m * 0.15e0 - d * 0.3e0), 6) AS math,
 round(greatest(0.1e0, 1 - CASE WHEN coalesce(kind, 'DESCRIPTIVE') = 'DESCRIPTIVE' THEN 0.1e0 ELSE 0 END - CASE WHEN kind LIKE 'MCQ%' AND o < 2 THEN 0.4e0 WHEN kind LIKE 'MCQ%' AND o <> 4 THEN 0.1e0 ELSE 0 END - CASE WHEN length(stem) < 20 THEN 0.2e0 ELSE 0 END), 6) AS semantic,
 round(1 - CASE WHEN tags = 0 THEN 0.1e0 ELSE 0 END - CASE WHEN level = 0 THEN 0.2e0 ELSE 0 END, 6) AS metadata, round(greatest(0.1e0, 1 - m * 0.1e0 - u * 0.15e0 - d * 0.25e0), 6) AS fidelity FROM p""")
def confidence_scores(t) -> DataFrame:
    """Four scores of a question from what its stages counted."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.get(F.array(F.lit(None).cast("string"), *(F.lit(x) for x in ("MCQ_SINGLE", "MCQ_MULTI", "DESCRIPTIVE", "NUMERICAL"))), (k % 5).cast("int"))
    c = confidences(size % 4, size % 3, size % 5, kind, size % 6, F.concat("p_name", "p_type"), k % 2, size % 13)
    return t("part").select("p_partkey", *(x.alias(n) for n, x in c.items()))
