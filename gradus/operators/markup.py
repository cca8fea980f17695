"""Markup: XML as nodes, formulas as LaTeX, typed blocks of pasted questions and of pages, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, mathml, office
from ..functions.intake import NUMBER
from ..sources import markup
from .registry import query


def _x(*parts: Column | str) -> Column:
    """Literal text and columns (named by `:column`) as one string."""
    named = lambda p: isinstance(p, str) and p[:1] == ":" and p[1:].isidentifier()
    return F.concat(*(F.col(p[1:]).cast("string") if named(p) else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _order_xml(t) -> DataFrame:
    """An XML document for each order, of as many elements as it has lines; one in ten has a wrong
    end tag, one lacks its last, one has an end too many."""
    line = _x('<line n="', ":l_linenumber", '" flag=\'', ":l_returnflag", "'><qty> ", F.col("l_quantity").cast("int"), "</qty>", F.when(F.col("l_tax") > 0.04, _x("<w:tax/>")).otherwise(""), "</line>\n")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("lines"))
    o = t("orders").join(lines, F.col("o_orderkey") == F.col("k"))
    body = _x('<?xml version="1.0"?>\n<!-- an <order> --><order id="', ":k", '">\n<status>', ":o_orderstatus", F.when(F.col("k") % 10 == 3, "</state>").otherwise("</status>"), ":lines", F.when(F.col("k") % 10 == 7, "").when(F.col("k") % 10 == 9, "</order></x>").otherwise("</order>"))
    return o.select("k", body.alias("xml"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), l AS (SELECT l_orderkey AS k, l_tax AS tax FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT path, count(*) AS n, count(*) FILTER (bad) AS n_errors, CAST(sum(a) AS BIGINT) AS n_attributes FROM (
 SELECT 'order' AS path, k % 10 = 7 AS bad, 1 AS a FROM o UNION ALL SELECT 'order/status', k % 10 = 3, 0 FROM o UNION ALL SELECT 'order/status/#text', false, 0 FROM o
 UNION ALL SELECT 'order/line', false, 2 FROM l UNION ALL SELECT 'order/line/qty', false, 0 FROM l UNION ALL SELECT 'order/line/qty/#text', false, 0 FROM l UNION ALL SELECT 'order/line/tax', false, 0 FROM l WHERE tax > 0.04e0
 UNION ALL SELECT '#stray', true, 0 FROM o WHERE k % 10 = 9) GROUP BY path""")
def xml_paths(t) -> DataFrame:
    """Nodes of XML documents by path, how many have an error, and their attributes."""
    n = markup.node_table(_order_xml(t), markup.xml_nodes, "xml", "k", fields=("name", "path", "attributes", "error")).where("name <> '#end'")
    return n.groupBy("path").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), F.sum(F.coalesce(F.size("attributes"), F.lit(0))).cast("bigint").alias("n_attributes"))


@query("SELECT l_orderkey AS k, count(*) AS n_lines, CAST(sum(CAST(floor(l_quantity) AS INT)) AS BIGINT) AS quantity, min(CAST(l_linenumber AS VARCHAR)) AS first_line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def xml_totals(t) -> DataFrame:
    """Values read back from XML: each quantity's text with the line around it.  A parent is found
    by its place in its own document's nodes, so that nothing but values leaves the document."""
    d = markup.with_nodes(_order_xml(t), markup.xml_nodes, "xml", "k", fields=("parent", "name", "attributes", "text"))
    above = lambda n: F.get("nodes", n["parent"])
    said = F.filter("nodes", lambda n: (n["name"] == "#text") & (above(n)["name"] == "qty") & (above(above(n))["name"] == "line"))
    row = lambda n: F.struct(F.try_element_at(above(above(n))["attributes"], F.lit("n")).alias("number"), F.trim(n["text"]).try_cast("int").alias("said"))
    rows = d.select("k", F.inline(F.transform(said, row)))
    return rows.groupBy("k").agg(F.count("*").alias("n_lines"), F.sum("said").cast("bigint").alias("quantity"), F.min("number").alias("first_line"))


_LINE_TEX = r"""CASE l_returnflag WHEN 'R' THEN '\frac{' || l_partkey || '}{' || l_suppkey || '}' WHEN 'A' THEN 'x^{' || l_suppkey || '}' ELSE '\sqrt[' || l_linenumber || ']{\frac{' || l_partkey || '}{a_' || l_suppkey || '}}' END"""
_LINE_PLAIN = "CASE l_returnflag WHEN 'R' THEN l_partkey || b || ' ' || l_suppkey WHEN 'A' THEN 'x ' || l_suppkey ELSE l_partkey || b || ' a ' || l_suppkey || ' ' || l_linenumber END"


@query(rf"""WITH l AS (SELECT *, CASE WHEN l_partkey % 100 = 0 THEN '}}' ELSE '' END AS b, CAST(floor(l_quantity) AS INT) AS q FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, bool_or(b <> '' AND l_returnflag <> 'A') AS odd, '\begin{{matrix}}' || string_agg(q || ' & ' || {_LINE_TEX}, ' \\ ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, q) || '\end{{matrix}}' AS m,
 string_agg(q || ' ' || {_LINE_PLAIN}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, q) AS p FROM l GROUP BY l_orderkey),
f AS (SELECT o_orderkey AS k, o_orderpriority, CASE WHEN odd THEN CASE o_orderstatus WHEN 'F' THEN n || ' i=1 ' ELSE '' END || p
 ELSE CASE o_orderstatus WHEN 'O' THEN '\left[ ' || m || ' \right]' WHEN 'F' THEN '\sum_{{i=1}}^{{' || n || '}} ' || m ELSE '\hat{{' || m || '}}' END END AS tex FROM orders JOIN g ON o_orderkey = l_orderkey)
SELECT k, '<p>Of ' || k || CASE WHEN o_orderpriority LIKE '1%' THEN ': ' || chr(10) || '$$' || tex || '$$' || chr(10) ELSE ': $' || tex || '$' END || ' end</p>' AS page FROM f""")
def formula_latex(t) -> DataFrame:
    """Pages with a word processor's formula for each order, a matrix of its lines with fractions,
    powers and nested roots inside brackets, a sum or a hat, as LaTeX.  Those with a brace that
    does not balance fall back to plain text."""
    run = lambda *c: _x("<m:r>\n<m:t>", *c, "</m:t></m:r>")
    brace = F.when(F.col("l_partkey") % 100 == 0, "}").otherwise("")
    fraction = lambda den: _x("<m:f><m:fPr/><m:num>", run(":l_partkey", brace), "</m:num><m:den>", den, "</m:den></m:f>")
    power = _x("<m:sSup><m:e>", run("x"), "</m:e><m:sup>", run(":l_suppkey"), "</m:sup></m:sSup>")
    indexed = _x("<m:sSub><m:e>", run("a"), "</m:e><m:sub>", run(":l_suppkey"), "</m:sub></m:sSub>")
    rooted = _x("<m:rad><m:deg>", run(":l_linenumber"), "</m:deg><m:e>", fraction(indexed), "</m:e></m:rad>")
    cell = F.when(F.col("l_returnflag") == "R", fraction(run(":l_suppkey"))).when(F.col("l_returnflag") == "A", power).otherwise(rooted)
    q = F.floor("l_quantity").cast("int")
    row = _x("<m:mr><m:e>", run(q), "</m:e><m:e>", cell, "</m:e></m:mr>")
    rows = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", q.alias("q"), row.alias("row")))).alias("rows"))
    m = _x("<m:m>", F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), "</m:m>")
    bracket = _x('<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val="]"/></m:dPr><m:e>', m, "</m:e></m:d>")
    total = _x('<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>', run("i=1"), "</m:sub><m:sup>", run(":n"), "</m:sup><m:e>", m, "</m:e></m:nary>")
    hat = _x('<m:acc><m:accPr><m:chr m:val="^"/></m:accPr><m:e>', m, "</m:e></m:acc>")
    math = _x("<m:oMath>", F.when(F.col("o_orderstatus") == "O", bracket).when(F.col("o_orderstatus") == "F", total).otherwise(hat), "</m:oMath>")
    math = F.when(F.col("o_orderpriority").startswith("1"), _x("<m:oMathPara>", math, "</m:oMathPara>")).otherwise(math)
    o = t("orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    pages = o.select(F.col("o_orderkey").alias("k"), _x("<p>Of ", ":o_orderkey", ": ", math, " end</p>").alias("html"))
    return pages.select("k", mathml.page_with_latex("html").alias("page"))


@query(r"""WITH f AS (SELECT p_partkey, p_size, 'p = ' || CASE p_size % 5 WHEN 0 THEN 'x_' || p_size WHEN 1 THEN '\left[ ' || p_size || ' \times \sin \right]' WHEN 2 THEN '∑_{i = 1}^{' || p_size || '}' WHEN 3 THEN '\vec{A} \neq \overset{~}{B}'
 ELSE '\sqrt[3]{\frac{' || p_size || '}{\text{' || p_brand || '}}}' END || ' \begin{matrix}\text{' || p_type || '} & ' || p_partkey || '\end{matrix}' AS tex FROM part)
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN chr(10) || '$$$$' || tex || '$$$$' || chr(10) ELSE '$' || tex || '$' END AS latex FROM f""")
def mathml_latex(t) -> DataFrame:
    """A browser's formulas as LaTeX; displayed ones get the dollars of both their markup and their place."""
    k = F.col("p_size") % 5
    size = _x("<mn>", ":p_size", "</mn>")
    kinds = [
        _x("<msub><mi>x</mi>", size, "</msub>"),
        _x('<mfenced open="[" close="]">', size, "<mo>×</mo><mi> sin </mi></mfenced>"),
        _x("<munderover><mo>∑</mo><mrow><mi>i</mi><mo>=</mo><mn>1</mn></mrow>", size, "</munderover>"),
        _x("<mover><mi>A</mi><mo>→</mo></mover><mo>≠</mo><mover><mi>B</mi><mo>~</mo></mover>"),
        _x("<mroot><mfrac>", size, "<mtext>", ":p_brand", "</mtext></mfrac><mn>3</mn></mroot>"),
    ]
    kind = F.coalesce(*(F.when(k == i, c) for i, c in enumerate(kinds)))
    table = _x("<mtable><mtr><mtd><mi>", ":p_type", "</mi></mtd><mtd><mn>", ":p_partkey", "</mn></mtd></mtr></mtable>")
    math = _x("<math", F.when(F.col("p_size") % 7 == 0, ' display="block"').otherwise(""), "><mi>p</mi>\n<mo>=</mo>", kind, table, "</math>")
    return t("part").select("p_partkey", mathml.page_with_latex(math).alias("latex"))


@query("""WITH s AS (SELECT p_brand || '/' || p_type AS k, p_partkey, p_name, p_size, ascii(substr(p_type, 1, 1)) % 3 AS how, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part),
q AS (SELECT DISTINCT k, 0 AS o, 'paragraph' AS kind, CAST(NULL AS VARCHAR) AS label, 'Which of ' || k || '?' AS text FROM s),
li AS (SELECT k, i + 1 AS o, 'list_item' AS kind, NULL AS label, '* ' || p_name || '  ' || p_size AS text FROM s WHERE how = 0),
op AS (SELECT k, 1 + i % 4 AS o, 'option' AS kind, chr(65 + CAST(i % 4 AS INT)) AS label, '(' || chr(65 + CAST(i % 4 AS INT)) || ') ' || string_agg(p_name, ' ' ORDER BY i) || CASE WHEN i % 4 = least(any_value(n), 4) - 1 THEN chr(10) || 'or so' ELSE '' END AS text FROM s WHERE how = 1 GROUP BY k, i % 4),
tb AS (SELECT k, 1 AS o, 'table' AS kind, NULL AS label, string_agg(p_name || chr(9) || p_size, chr(10) ORDER BY i) AS text FROM s WHERE how = 2 GROUP BY k),
e AS (SELECT DISTINCT k, 1000000 AS o, 'paragraph' AS kind, NULL AS label, '2. Next one' AS text FROM s)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY o) AS INT) AS place, kind, label, text FROM (SELECT * FROM q UNION ALL SELECT * FROM li UNION ALL SELECT * FROM op UNION ALL SELECT * FROM tb UNION ALL SELECT * FROM e)""")
def paste_blocks(t) -> DataFrame:
    """Typed blocks of pasted questions, whose parts are lists, options with repeated labels and a
    line that goes on, or tables, of as many rows as there are parts of a kind."""
    by = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    how = F.ascii(F.substring("p_type", 1, 1)) % 3
    p = t("part").withColumn("i", F.row_number().over(by) - 1)
    label = F.chr(65 + F.col("i") % 4)
    row = F.when(how == 0, _x("<li class=MsoList>", ":p_name", " <b>", ":p_size", "</b>")).when(how == 1, _x('<p class="MsoNormal" style="mso-x:1">(', label, ") <span>", ":p_name", "</span><o:p></o:p></p>")).otherwise(_x("<tr><td width=10>", ":p_name", "<td>", ":p_size", "</tr>"))
    g = p.groupBy("p_brand", "p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    body = F.when(how == 0, _x("<ul>", ":rows", "</ul>")).when(how == 1, _x(":rows", "<p>or so</p>")).otherwise(_x("<table>", ":rows", "</table>"))
    k = _x(":p_brand", "/", ":p_type")
    html = _x("<html><head><style>p {}</style></head><body><!--StartFragment-->\n<p>Which of ", k, "?", body, "<p>2. Next one</p><p> </p></body></html>")
    return blocks.page_blocks(g.select(k.alias("k"), html.alias("html")), "html", "k").select("k", "place", "kind", "label", "text")


def _sql_said(c: str) -> str:
    """Markup as text in SQL: breaks as line ends, other tags as spaces, references."""
    out = f"regexp_replace(regexp_replace({c}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for name, char in (("nbsp", "chr(160)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("apos", "chr(39)"), ("amp", "'&'")):
        out = f"replace({out}, '&{name};', {char})"
    return f"translate({out}, chr(160), ' ')"


def _sql_trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_BREAKS = "|".join(sorted(markup.BLOCKS | {"li", "td", "th", "tr", "body", "html", "center"}, key=len, reverse=True))
_PREFIX = r"(?i)^\s*(?:<[^>]+>)*" + blocks.OPTION_START.removeprefix("(?i)^") + r"\s*(?:<[^>]+>)*"


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|head)\b.*?</(script|style|head)\s*>', '', 'g') AS h FROM pages),
s AS (SELECT page_id, unnest(range(1, len(ps) + 1)) AS i, ps FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(?i)<li\b[^>]*>', chr(1) || chr(2), 'g'), '(?i)</?(?:{_BREAKS})\b[^>]*>', chr(1), 'g'), chr(1)) AS ps FROM p)),
b AS (SELECT page_id, i, starts_with(ps[i], chr(2)) AS li, trim(replace(ps[i], chr(2), ''), ' ') AS m, {_sql_trimmed(_sql_said("replace(ps[i], chr(2), '')"))} AS t FROM s),
k AS (SELECT page_id, i, li, m, CASE WHEN regexp_matches(t, '{blocks.OPTION_START}') THEN upper(regexp_extract(t, '{blocks.OPTION_START}', 1) || regexp_extract(t, '{blocks.OPTION_START}', 2)) END AS label FROM b WHERE li OR t <> ''),
f AS (SELECT *, CASE WHEN label IS NOT NULL THEN min(i) OVER (PARTITION BY page_id, label) END AS first, label IS NULL AND NOT li AND NOT regexp_matches(m, '{NUMBER}') AS goes_on FROM k),
o AS (SELECT *, last_value(CASE WHEN coalesce(first = i, true) AND NOT goes_on THEN {{'i': i, 'opt': label IS NOT NULL}} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opener FROM f),
g AS (SELECT page_id, CASE WHEN label IS NOT NULL THEN first WHEN goes_on AND opener.opt THEN opener.i ELSE i END AS at_i, i, li, label, {_sql_said(f"CASE WHEN label IS NOT NULL THEN trim(regexp_replace(m, '{_PREFIX}', ''), ' ') ELSE m END")} AS piece FROM o),
j AS (SELECT page_id, at_i, arg_min(li, i) AS li, min(label) AS label, {_sql_trimmed("string_agg(CASE WHEN i = at_i THEN '' WHEN label IS NOT NULL THEN ' ' ELSE chr(10) END || piece, '' ORDER BY i)")} AS t FROM g GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY at_i) AS INT) AS place, CASE WHEN label IS NOT NULL THEN 'option' WHEN li THEN 'list_item' ELSE 'paragraph' END AS kind,
 regexp_replace(CASE WHEN label IS NOT NULL THEN '(' || label || ') ' WHEN li THEN '* ' ELSE '' END || t, '\s+', ' ', 'g') AS text FROM j""")
def page_blocks(t) -> DataFrame:
    """Typed blocks of whole pages, their containers opened; white space in a text as one space."""
    found = blocks.page_blocks(t("pages"), "html", "page_id", into=blocks.CONTAINERS)
    return found.select("page_id", "place", "kind", F.regexp_replace("text", r"\s+", " ").alias("text"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?is)<(script|style|title|textarea)\b([^>]*)>.*?</(script|style|title|textarea)\s*>', '<\1\2></\1>', 'g') AS h FROM pages),
s AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][^\s/>]*)[^>]*>', 1))) AS name FROM p)
SELECT page_id, name, count(*) AS n FROM s WHERE name NOT IN ('html', 'body') GROUP BY ALL""")
def page_elements(t) -> DataFrame:
    """Elements of pages by name."""
    n = markup.node_table(t("pages"), markup.html_nodes, "html", "page_id", fields=("name",))
    return n.where("not startswith(name, '#')").groupBy("page_id", "name").agg(F.count("*").alias("n"))


_VOID_SQL = ", ".join(f"'{v}'" for v in sorted(markup.VOID))


@query(rf"""WITH c AS (SELECT page_id, substr(html, 1, CAST(length(html) * (1 + page_id % 4) // 4 AS BIGINT)) AS h FROM pages),
r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?is)<(script|style|title|textarea)\b[^>]*>.*?(</(script|style|title|textarea)\s*>|$)', '<\1>\2', 'g'), '<[^>]*$', '') AS h FROM c),
n AS (SELECT page_id, len(list_filter(regexp_extract_all(h, '<([a-zA-Z][^\s/>]*)[^>]*>', 1), lambda x: lower(x) NOT IN ({_VOID_SQL}))) AS starts, len(regexp_extract_all(h, '</[a-zA-Z][^>]*>')) AS ends FROM r)
SELECT page_id, CAST(starts - ends AS BIGINT) AS added, CAST(starts AS BIGINT) AS n_ends FROM n""")
def repaired_pages(t) -> DataFrame:
    """Pages that were cut off somewhere, with every element ended: the ends that were added, less
    those that went, and the ends there are now."""
    cut = F.substring(F.col("html"), F.lit(1), F.expr("cast(length(html) * (1 + page_id % 4) div 4 as int)"))
    r = markup.with_nodes(t("pages").select("page_id", cut.alias("html")), markup.tag_nodes, "html", "page_id", fields=("name", "raw", "error"))
    elements = F.filter("nodes", lambda n: markup.has_end(n))
    of = lambda *e: F.size(F.filter("nodes", lambda n: n["error"].isin(*e))).cast("bigint")
    return r.select("page_id", (of("unclosed", "crossed") - of("end without start")).alias("added"), F.size(elements).cast("bigint").alias("n_ends"))


@query(r"""WITH p AS (SELECT *, p_size % 8 AS k FROM part)
SELECT p_partkey, 1 AS place, 's' || p_partkey AS shape, CASE WHEN k IN (0, 1, 2, 3, 4) THEN 'formula' WHEN k = 5 THEN 'figure' ELSE 'unresolved' END AS kind,
 CASE k WHEN 0 THEN 'omml' WHEN 1 THEN 'mathml' WHEN 2 THEN 'ole' WHEN 3 THEN 'vml' WHEN 4 THEN 'img_alt' END AS origin,
 CASE k WHEN 0 THEN '\frac{' || p_size || '}{' || p_partkey || '}' WHEN 1 THEN '$' || p_size || ' \times x$' WHEN 2 THEN 'x+' || p_size WHEN 3 THEN 'y=' || p_size WHEN 4 THEN 'z-' || p_size WHEN 5 THEN 'pic' || p_size || '.png' END AS value,
 CASE WHEN k = 5 THEN p_name || '!' END AS caption FROM p
UNION ALL SELECT p_partkey, 2, 'last', 'formula', 'vml', 'abc', NULL FROM p""")
def drawing_formulas(t) -> DataFrame:
    """What a word processor's drawings stand for, by the first of their representations that is a formula."""
    k = F.col("p_size") % 8
    shape = lambda *inside: _x('<v:shape id="s', ":p_partkey", '">', *inside, "</v:shape>")
    data = lambda src, *title: _x('<v:imagedata src="', src, '" o:title="', *title, '"/>')
    ole = lambda *more: _x('<!--[if gte mso 9]><xml><o:OLEObject Type="Embed" ShapeID="s', ":p_partkey", '"', *more, "></o:OLEObject></xml><![endif]-->")
    image = lambda *more: _x('<img width=10 v:shapes="s', ":p_partkey", '"', *more, ">")
    omml = _x("<m:oMath><m:f><m:num><m:r><m:t>", ":p_size", "</m:t></m:r></m:num> <m:den><m:r><m:t>", ":p_partkey", "</m:t></m:r></m:den></m:f></m:oMath>")
    kinds = [
        _x(shape(omml, "<math><mi>no</mi></math>"), ole(' title="a+b"')),
        _x(ole(' title="a+b"'), shape("<v:textbox><math>\n<mn>", ":p_size", "</mn> <mo>×</mo><mi>x</mi></math></v:textbox>", data("x.wmf", "c=d"))),
        _x(shape(data("x.wmf", "y=1")), ole(' alt="x+', ":p_size", '"')),
        _x(ole(' alt="some words"'), shape(data("x.png", "y=", ":p_size"))),
        _x(shape(data("x.png", "two words")), image(' alt="Equation z-', ":p_size", '"')),
        _x(shape(data(_x("pic", ":p_size", ".png"), ":p_name", "!"))),
        _x(shape(data("equation7.gif", "two words"))),
        _x(shape(), ole(' ProgID="Equation.3"'), image(' src="a.gif"')),
    ]
    html = _x("<p>", F.coalesce(*(F.when(k == i, c) for i, c in enumerate(kinds))), "</p><p><v:shape o:spid=last><v:imagedata src='a' title='abc'></v:shape> end<img src=plain.gif>")
    return office.drawings(t("part").select("p_partkey", html.alias("html")), "html", "p_partkey")
