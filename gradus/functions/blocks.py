"""Typed blocks of pages: paragraphs, options, list items and tables of pasted questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.markup import BLOCKS, has_end, html_nodes, with_nodes, within
from .intake import NUMBER, html_unescaped, once
from .mathml import page_with_latex

# What begins an option, elements that are no content, and the
# attributes that stay.
OPTION_START = r"(?i)^\s*(?:\(?\s*([a-fA-F])\s*\)?\s*[).:\-–—]\s*|([a-fA-F])\s*[).:\-–—]\s+)"
JUNK = "style xml script meta link title head officedocumentsettings worddocument latentstyles themedata colorschememapping background formulas path stroke shadow fill textbox rect line oval arc curve polyline group image shapetype".split()
KEPT = {"img": ("src",), "a": ("href",), "td": ("colspan", "rowspan", "align", "valign"), "th": ("colspan", "rowspan", "align", "valign")}

_JUNK_NAME = rf"(?:[owvx]:[^/]*|m:(?!omath$|omath/|omathpara)[^/]*|{'|'.join(JUNK)})"
_JUNK_PATH = rf"(?:^|/){_JUNK_NAME}(?:/|$)"
_JUNK_END = rf"(?i)</(?:[owvxm]:[^>]*|(?:{'|'.join(JUNK)})\s*)>"
#: Containers that may be looked into for their blocks.
CONTAINERS = ("div", "article", "section", "main", "center", "form", "header", "footer", "aside", "nav")


def _start(n: Column) -> Column:
    """A start tag with the attributes that stay."""
    out = F.concat(F.lit("<"), n["name"])
    for name, attributes in KEPT.items():
        for a in attributes:
            value = F.try_element_at(n["attributes"], F.lit(a))
            out = F.concat(out, F.when((n["name"] == name) & value.isNotNull(), F.concat(F.lit(f' {a}="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))).otherwise(F.lit("")))
    return F.concat(out, F.lit(">"))


def _content(inside: Column) -> Column:
    """Markup of the nodes inside an element, without junk."""
    good = F.filter(inside, lambda n: ~n["name"].isin("#stray", "#comment", "#end") & ~F.coalesce(n["path"], F.lit("")).rlike(_JUNK_PATH))
    last = F.get(inside, F.size(inside) - 1)["id"]

    def put(nodes: Column) -> Column:
        starts = F.transform(nodes, lambda n, i: F.concat(F.when(i == 0, "").otherwise(n["lead"]), F.coalesce(n["text"], _start(n))))
        ends = F.transform(F.filter(nodes, lambda n: (n["last"] == last) & has_end(n)), lambda n: F.concat(F.lit("</"), n["name"], F.lit(">")))
        return F.trim(F.regexp_replace(F.concat(F.array_join(starts, ""), F.array_join(F.reverse(ends), "")), _JUNK_END, ""))

    return once(good, put)


def text_of(content: Column) -> Column:
    """The text of a block's markup: breaks as line ends, other tags as spaces."""
    c = F.regexp_replace(F.regexp_replace(content, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", " ")
    return F.regexp_replace(F.translate(html_unescaped(c), "\u00a0", " "), r"^\s+|\s+$", "")


def _label(text: Column) -> Column:
    return F.upper(F.concat(F.regexp_extract(text, OPTION_START, 1), F.regexp_extract(text, OPTION_START, 2)))


#: What `units` reads of nodes.
FIELDS = ("id", "parent", "last", "depth", "name", "path", "attributes", "text", "raw", "lead")


def units(pages: DataFrame, *keys: str, into: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of pages before they are joined: keys, pos, kind, label, content, text.

    pages: keys and `nodes` (`sources.markup.NODES`).  Top elements are blocks: those of the body,
    and with `into` those of containers of these names that hold block elements.  Text outside of
    elements and elements without text are none.  A table with two or more option cells gives
    these; a list gives its items.  Null or empty pages give no rows.  A row carries the nodes of
    its own block only; a block is as large as its page at most.
    """
    nodes = F.col("nodes")
    top_path = rf"^(?:(?:{'|'.join(into) or '#none'})/)*[^/]+$"
    blocks = sorted(BLOCKS)

    def is_top(n: Column) -> Column:
        opened = n["name"].isin(*into) & F.exists(within(nodes, n), lambda x: x["name"].isin(*blocks)) if into else F.lit(False)
        good = ~n["name"].startswith("#") & ~n["name"].rlike(f"^{_JUNK_NAME}$")
        return good & F.coalesce(n["path"], F.lit("/")).rlike(top_path) & ((n["depth"] == 0) | n["name"].isin(*blocks)) & ~opened

    one = lambda role, n: F.struct(F.lit(role).alias("role"), n["id"].alias("id"), n["parent"].alias("row"), within(nodes, n).alias("inside"))
    named = lambda n, *names: F.filter(within(nodes, n), lambda x: x["name"].isin(*names))
    parts = lambda n: F.when(n["name"] == "table", F.concat(F.array(one("table", n)), F.transform(named(n, "td", "th"), lambda x: one("cell", x)))).when(n["name"].isin("ul", "ol"), F.transform(named(n, "li"), lambda x: one("item", x))).otherwise(F.array(one("block", n)))
    tops = pages.select(*keys, F.posexplode(F.transform(F.filter(nodes, is_top), parts)).alias("top", "parts"))
    u = tops.select(*keys, "top", F.posexplode("parts").alias("at", "part")).select(*keys, "top", "at", "part.role", "part.row", _content(F.col("part.inside")).alias("content"))
    u = u.withColumn("text", text_of(F.col("content")))
    u = u.withColumn("option", F.col("text").rlike(OPTION_START) & (F.col("role") != "table"))
    # A table's text is its cells by rows, made once, for the table's own row; with two options it
    # is only its cells' layout.
    # The number of options is an aggregate: as an expression over the rows it would be made anew for each.
    rows = F.array_sort(F.collect_list(F.struct("at", "role", "row", "content", "text", "option"))).alias("rows")
    g = u.groupBy(*keys, "top").agg(rows, F.count_if((F.col("role") == "cell") & F.col("option")).alias("options"))
    is_cell = lambda r: r["role"] == "cell"
    gap = lambda cells, c, i: F.when(i == 0, "").when(c["row"] == F.get(cells, i - 1)["row"], "\t").otherwise("\n")
    grid = once(F.filter("rows", is_cell), lambda cells: F.array_join(F.transform(cells, lambda c, i: F.concat(gap(cells, c, i), c["text"])), ""))
    fields = ("at", "role", "content", "text", "option")
    row = lambda r: F.struct(*(r[f].alias(f) for f in fields), F.when(r["role"] == "table", grid).alias("grid"))
    u = g.select(*keys, "top", "options", F.inline(F.transform("rows", row)))
    u = u.where(F.when(F.col("role") == "cell", (F.col("options") >= 2) & F.col("option")).when(F.col("role") == "table", F.col("options") < 2).otherwise((F.col("role") == "item") | (F.col("text") != "")))
    kind = F.when(F.col("role") == "table", "table").when(F.col("option"), "option").when(F.col("role") == "item", "list_item").otherwise("paragraph")
    prefix = r"(?i)^\s*(?:<[^>]+>)*" + OPTION_START.removeprefix("(?i)^") + r"\s*(?:<[^>]+>)*"
    content = F.when(kind == "option", F.trim(F.regexp_replace("content", prefix, ""))).when(kind == "table", F.concat(F.lit("<table>"), "content", F.lit("</table>"))).otherwise(F.col("content"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("top", "at"))
    return u.select(*keys, pos.alias("pos"), kind.alias("kind"), F.when(kind == "option", _label(F.col("text"))).alias("label"), content.alias("content"), "grid")


def plain_units(docs: DataFrame, *keys: str) -> DataFrame:
    """Blocks of plain text (keys, text), as `units`: a line each, options and paragraphs."""
    lines = docs.select(*keys, F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    line = F.col("line")
    option = line.rlike(OPTION_START + r"\s*\S")
    return lines.select(*keys, "pos", F.when(option, "option").otherwise("paragraph").alias("kind"), F.when(option, _label(line)).alias("label"), F.when(option, F.regexp_replace(line, OPTION_START, "")).otherwise(line).alias("content"), F.lit(None).cast("string").alias("grid"))


def joined_blocks(b: DataFrame, *keys: str) -> DataFrame:
    """Blocks of documents from their `units`: keys, place, kind, label, content, text.

    Options of one label are one block, at the first's place.  A paragraph that does not begin a
    question goes on with the block before it if that is an option.  Which block that is follows
    from the last one that opens for sure: any but such paragraphs and repeated labels.
    """
    alike = Window.partitionBy(*keys, "kind", "label")
    b = b.withColumns({"first": F.min("pos").over(alike), "goes_on": (F.col("kind") == "paragraph") & ~F.col("content").rlike(NUMBER)})
    b = b.withColumn("repeats", (F.col("kind") == "option") & (F.col("pos") > F.col("first")))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.last(F.when(~F.col("repeats") & ~F.col("goes_on"), F.struct("pos", "kind")), ignorenulls=True).over(before)
    b = b.withColumn("opener", opener)
    to = F.when(F.col("repeats"), F.col("first")).when(F.col("goes_on") & (F.col("opener.kind") == "option"), F.col("opener.pos")).otherwise(F.col("pos"))
    b = b.withColumn("to", to)
    glue = F.when(F.col("to") == F.col("pos"), "").when(F.col("repeats"), " ").otherwise("<br/>")
    g = b.groupBy(*keys, "to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(glue, "content").alias("piece")))), lambda x: x["piece"]), "").alias("content"), *(F.min_by(c, "pos").alias(c) for c in ("kind", "label", "grid")))
    g = g.withColumn("text", text_of(F.col("content")))
    text = F.when(F.col("kind") == "table", F.col("grid")).when(F.col("kind") == "option", F.concat(F.lit("("), "label", F.lit(") "), "text")).when(F.col("kind") == "list_item", F.concat(F.lit("* "), "text")).otherwise(F.col("text"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("to"))
    return g.select(*keys, place.alias("place"), "kind", "label", "content", text.alias("text"))


def plain_text(blocks: DataFrame, *keys: str) -> DataFrame:
    """Documents as plain text: their blocks' texts in order, a blank line between."""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), lambda x: x != "")
    return blocks.groupBy(*keys).agg(F.array_join(texts, "\n\n").alias("text"))


def page_blocks(pages: DataFrame, html: str, *keys: str, into: tuple[str, ...] = ()) -> DataFrame:
    """Typed blocks of pages, as `joined_blocks`, with formulas as LaTeX.  Rows with equal keys
    must not repeat: keys name a page."""
    latex = pages.select(*keys, page_with_latex(F.col(html)).alias("html"))
    return joined_blocks(units(with_nodes(latex, html_nodes, "html", *keys, fields=FIELDS), *keys, into=into), *keys)
