"""What a word processor's drawings stand for: formulas, figures, or what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.markup import html_nodes, with_nodes
from .mathml import nodes_latex

# A title that is a formula, names of formula images and programs, and the order in
# which representations of one drawing are believed.
FORMULA_TITLE = r"(?i)[+\-=*/≤≥≠]|\\|^\s*[a-zA-Z0-9_^]+\s*$"
FORMULA_SOURCE = r"math|equation|\.wmf"
FORMULA_PROGRAM = r"(?i)Equation\."
ORIGINS = ("omml", "mathml", "ole", "vml", "img_alt")
#: Comments around what only some programs read; what is inside counts.
CONDITIONS = r"(?i)<!--\[if[^\]]*\]>|<!\[endif\]-->|<!\[if[^\]]*\]>|<!\[endif\]>"


def _local(n: Column) -> Column:
    return F.substring_index(n["name"], ":", -1)


def representations(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """Representations of drawings: keys, shape, node, parent, kind, title,
    src, program, latex.

    A drawing is what shares a shape's id: the shape, its image data, formulas inside, the
    embedded object and the image that name it.  Of nested shapes the innermost counts.  Elements
    outside of drawings give no rows.
    """
    shown = pages.select(*keys, F.regexp_replace(html, CONDITIONS, "").alias("html"))
    nodes = F.col("nodes")
    value = lambda n, *names: F.coalesce(*(F.nullif(F.trim(F.try_element_at(n["attributes"], F.lit(a))), F.lit("")) for a in names), F.lit(None).cast("string"))
    shapes = F.filter(nodes, lambda n: _local(n) == "shape")
    p = with_nodes(shown, html_nodes, "html", *keys, fields=("id", "parent", "last", "root", "depth", "name", "attributes", "text")).select(*keys, "nodes", shapes.alias("shapes"))

    def own_shape(n: Column) -> Column:
        around = F.filter("shapes", lambda s: (s["id"] < n["id"]) & (s["last"] >= n["last"]))
        return F.when(F.size(around) > 0, value(F.get(around, F.size(around) - 1), "id", "spid"))

    def row(n: Column) -> Column:
        kind = F.when(_local(n).isin("omath", "omathpara"), "omml").when(_local(n) == "math", "mathml").otherwise(_local(n))
        shape = F.when(kind == "shape", value(n, "id", "spid")).when(kind == "oleobject", value(n, "shapeid", "id")).when(kind == "img", value(n, "shapes")).otherwise(own_shape(n))
        tree = F.when(kind.isin("omml", "mathml") & shape.isNotNull(), F.slice(nodes, n["id"] + 1, n["last"] - n["id"] + 1))
        title = F.when(kind == "imagedata", value(n, "title")).otherwise(value(n, "alt", "title"))
        return F.struct(shape.alias("shape"), n["id"].alias("node"), n["parent"].alias("parent"), kind.alias("kind"), title.alias("title"), value(n, "src").alias("src"), value(n, "progid").alias("program"), tree.alias("tree"))

    found = F.filter(nodes, lambda n: _local(n).isin("shape", "imagedata", "oleobject", "img", "omath", "omathpara", "math"))
    r = p.select(*keys, F.inline(F.transform(found, row))).where("shape is not null")
    return r.select(*keys, "shape", "node", "parent", "kind", "title", "src", "program", F.trim(nodes_latex("tree")).alias("latex"))


def drawings(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """What each drawing of a page is: keys, place, shape, kind (formula, figure, unresolved),
    origin, value, caption.

    The first of ORIGINS that gives a formula counts: markup inside the shape, the title of the
    embedded object, of the image data, of the image, titles only if they look like formulas.  Else
    a drawing with a source is a figure, unless its source or program is that of a formula.
    Drawings are numbered by the node that stands for them: image, shape or object.
    """
    r = representations(pages, html, *keys)
    last = lambda kind, value: F.max_by(F.when(F.col("kind") == kind, F.col(value)), F.when(F.col("kind") == kind, F.col("node")))
    g = r.groupBy(*keys, "shape").agg(
        last("omml", "latex").alias("omml"), last("mathml", "latex").alias("mathml"),
        last("oleobject", "title").alias("ole"), last("imagedata", "title").alias("vml"), last("img", "title").alias("img_alt"),
        last("imagedata", "src").alias("data_src"), last("img", "src").alias("img_src"), last("oleobject", "program").alias("program"),
        F.coalesce(last("img", "node"), last("shape", "node"), last("oleobject", "node")).alias("at"),
    ).where("at is not null")
    formula = lambda c: F.when(F.col(c).rlike(FORMULA_TITLE), F.col(c))
    g = g.withColumn("caption", F.coalesce("vml", "img_alt")).withColumns({c: formula(c) for c in ("ole", "vml")})
    g = g.withColumn("img_alt", F.trim(F.regexp_replace(formula("img_alt"), r"(?i)Equation\b", "")))
    g = g.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ORIGINS})
    origin = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in ORIGINS))
    value = F.coalesce(*ORIGINS)
    src = F.coalesce("data_src", "img_src")
    of_formula = F.coalesce(src.rlike(FORMULA_SOURCE), F.lit(False)) | F.coalesce(F.col("program").rlike(FORMULA_PROGRAM), F.lit(False))
    kind = F.when(origin.isNotNull(), "formula").when(src.isNotNull() & ~of_formula, "figure").otherwise("unresolved")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    return g.select(*keys, place.alias("place"), "shape", kind.alias("kind"), origin.alias("origin"), F.when(kind == "figure", src).otherwise(value).alias("value"), F.when(kind == "figure", F.col("caption")).alias("caption"))
