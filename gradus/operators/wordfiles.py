"""Word files made of the standard tables, read as paragraphs, as HTML and as images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex
from ..sources import docx
from .registry import query


def _run(said, properties: str = ""):
    said = F.replace(F.replace(said.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit(f"<w:r><w:rPr>{properties}</w:rPr><w:t>"), said, F.lit("</w:t></w:r>"))


def _paragraph(*runs, properties: str = ""):
    return F.concat(F.lit(f"<w:p><w:pPr>{properties}</w:pPr>"), *runs, F.lit("</w:p>"))


def _files(t) -> DataFrame:
    """A file for each brand: a heading, its parts as a list, a table of their kinds and an image."""
    listed = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr>'
    item = _paragraph(_run(F.col("p_name"), "<w:b/>"), _run(F.lit(" & ")), _run(F.col("p_size"), '<w:vertAlign w:val="superscript"/>'), properties=listed)
    row = F.concat(F.lit("<w:tr><w:tc>"), _paragraph(_run(F.col("p_type"))), F.lit("</w:tc><w:tc>"), _paragraph(_run(F.col("p_partkey"), '<w:i/><w:b w:val="0"/>')), F.lit("</w:tc></w:tr>"))
    p, key = t("part"), F.col("p_partkey")
    brands = p.select("p_brand").distinct()
    none = F.lit(None).cast("binary")
    piece = lambda d, section, place, said, image=none: d.select(F.col("p_brand").alias("path"), F.lit(section).alias("section"), F.lit(place).cast("bigint").alias("place"), said.alias("piece"), image.alias("image"))
    last = F.concat(F.lit("</w:tbl><w:p/>"), _paragraph(F.lit('<w:r><w:drawing><a:blip r:embed="r1"/><a:blip r:embed="r9"/></w:drawing></w:r>')))
    pieces = piece(brands, 0, 0, _paragraph(_run(F.col("p_brand")), properties='<w:pStyle w:val="Heading2"/>'), F.encode(F.concat(F.lit("image of "), "p_brand"), "utf-8"))
    for more in (piece(p, 1, key, item), piece(brands, 2, 0, F.lit("<w:tbl>")), piece(p, 3, key, row), piece(brands, 4, 0, last)):
        pieces = pieces.union(more)
    broken = F.col("path").endswith("5")
    files = docx.packed_files(pieces, "section", "place").withColumn("content", F.when(broken, F.encode(F.lit("no archive"), "utf-8")).otherwise(F.col("content")))
    # A brand that is null is a file that cannot be read.
    return files.union(brands.where("p_brand is null").select(F.col("p_brand"), none))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE NOT ends_with(p_brand, '5'))
SELECT DISTINCT p_brand AS path, CAST(0 AS BIGINT) AS pos, p_brand AS text, false AS is_table, CAST(NULL AS VARCHAR) AS num_id FROM p UNION ALL SELECT p_brand, i, p_name || ' & ' || p_size, false, '3' FROM p
UNION ALL SELECT p_brand, any_value(n) + 1, '[TABLE]' || chr(10) || string_agg(p_type || ' | ' || p_partkey, chr(10) ORDER BY p_partkey), true, NULL FROM p GROUP BY p_brand""")
def word_paragraphs(t) -> DataFrame:
    """Paragraphs, list items and tables of Word files."""
    return docx.paragraphs_of(_files(t)).where("error is null").select("path", "pos", "text", "is_table", "num_id")


@query("""SELECT p_brand AS path, CASE WHEN NOT ends_with(p_brand, '5') THEN '<h2>' || p_brand || '</h2><ol>' || string_agg('<li><strong>' || p_name || '</strong> &amp; <sup>' || p_size || '</sup></li>', '' ORDER BY p_partkey) || '</ol><table>' || string_agg('<tr><td><p>' || p_type || '</p></td><td><p><em>' || p_partkey || '</em></p></td></tr>', '' ORDER BY p_partkey) || '</table><p><img src="image-1.png"></p>' END AS html,
 CASE WHEN NOT ends_with(p_brand, '5') THEN 1 END AS n_images, ends_with(p_brand, '5') AS broken FROM part GROUP BY p_brand""")
def word_pages(t) -> DataFrame:
    """Word files as HTML."""
    return docx.pages(_files(t)).select("path", "html", F.size("images").alias("n_images"), F.col("error").isNotNull().alias("broken"))


@query("SELECT DISTINCT p_brand AS path, 1 AS place, 'image-1.png' AS name, 'image of ' || p_brand AS content FROM part WHERE NOT ends_with(p_brand, '5')")
def word_images(t) -> DataFrame:
    """Images that Word files show."""
    return docx.images(docx.pages(_files(t))).withColumn("content", F.decode("content", "utf-8"))


@query(r"""SELECT p_brand AS path, p_brand || string_agg('\mathbf{' || p_name || '} & ^{' || p_size || '}', '' ORDER BY p_partkey) || string_agg(p_type || chr(10) || p_partkey || chr(10), '' ORDER BY p_partkey) AS said FROM part WHERE NOT ends_with(p_brand, '5') GROUP BY p_brand""")
def word_texts(t) -> DataFrame:
    """Word files as text, with raised and bold text as LaTeX."""
    p = docx.pages(_files(t)).where("error is null")
    return p.select("path", F.concat(latex.with_scripts(F.col("html")), F.lit("\n")).alias("said"))
