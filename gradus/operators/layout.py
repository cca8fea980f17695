"""Reading order of pages with columns, and of recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout
from .registry import query


@query("""WITH p AS (SELECT *, CAST(right(p_brand, 1) AS INT) % 3 + 1 AS n, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS i FROM part),
t AS (SELECT p_brand, p_type, any_value(n) AS n, string_agg(p_name || CASE WHEN i % 5 = 0 AND n > 1 THEN ' and more' WHEN i % 5 = 0 THEN chr(10) || 'and more' ELSE '' END, chr(10) ORDER BY i) AS a,
 string_agg('of ' || p_type || ' kind', chr(10) ORDER BY i) AS b, string_agg('number ' || p_partkey, chr(10) ORDER BY i) AS c, count(*) AS rows FROM p GROUP BY ALL),
g AS (SELECT p_brand, p_type, '1. The ' || p_type || ' list' || chr(10) || a || CASE WHEN n > 1 THEN chr(10) || chr(10) || b ELSE '' END || CASE WHEN n > 2 THEN chr(10) || chr(10) || c ELSE '' END AS page FROM t WHERE rows > 5)
SELECT p_brand, string_agg(page, chr(10) || chr(10) || '--- Page break ---' || chr(10) || chr(10) ORDER BY p_type) AS text FROM g GROUP BY p_brand""")
def reading_order(t) -> DataFrame:
    """Documents of pages with one to three columns, as many rows as there are parts of a kind."""
    n = F.right("p_brand", F.lit(1)).cast("int") % 3 + 1
    by = Window.partitionBy("p_brand", "p_type")
    p = t("part").withColumns({"i": F.row_number().over(by.orderBy("p_partkey")), "rows": F.count("*").over(by)}).where("rows > 5")
    row = F.concat("p_name", F.when(n > 1, F.concat(F.lit("\t\tof "), "p_type", F.lit(" kind  "))).otherwise(""), F.when(n > 2, F.concat(F.lit("    number "), F.col("p_partkey").cast("string"))).otherwise(""), F.when(F.col("i") % 5 == 0, "\r\nand more").otherwise(""))
    pages = p.groupBy("p_brand", "p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    page = F.concat(F.lit("1. The "), "p_type", F.lit(" list\n"), "rows")
    docs = pages.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", page.alias("page")))), lambda x: x["page"]), "\n--- page 12 ---\n").alias("text"))
    return layout.documents_in_order(docs, "text", "p_brand")


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS page, 'w' || l_partkey || '-' || l_linenumber AS text, l_extendedprice % 800 AS x0, l_quantity * 3 AS y0, l_quantity * 3 + 10 + l_linenumber AS y1, l_suppkey % 40 AS wide FROM lineitem),
o AS (SELECT *, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY page ORDER BY y0, x0, text, x0 + wide, y1) AS i FROM w),
r AS (SELECT page, i, cy, [cy] AS seeds FROM o WHERE i = 1
 UNION ALL SELECT o.page, o.i, o.cy, CASE WHEN len(list_filter(r.seeds, lambda s: abs(s - o.cy) <= 12)) > 0 THEN r.seeds ELSE list_append(r.seeds, o.cy) END FROM r JOIN o ON o.page = r.page AND o.i = r.i + 1),
l AS (SELECT o.*, list_filter(r.seeds, lambda s: abs(s - o.cy) <= 12)[1] AS y FROM o JOIN r USING (page, i)),
g AS (SELECT page, y, string_agg(text, ' ' ORDER BY x0, i) AS text, min(x0) AS min_x, max(x0 + wide) AS max_x FROM l GROUP BY page, y)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y) AS INT) AS line, text, y, min_x, max_x FROM g""")
def word_lines(t) -> DataFrame:
    """Words with places as lines, by first fit."""
    x0, y0 = F.col("l_extendedprice") % 800, F.col("l_quantity") * 3
    words = t("lineitem").select(F.col("l_orderkey").alias("page"), F.concat(F.lit("w"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_suppkey") % 40).alias("x1"), (y0 + 10 + F.col("l_linenumber")).alias("y1"))
    return layout.word_lines(words, "page")
