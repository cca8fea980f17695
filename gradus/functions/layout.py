"""Reading order: columns of a page's text, and recognised words as lines."""

from __future__ import annotations

import re
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# White space, ends of pages, gaps between columns, shares of lines with so many
# parts that make columns, the length from which a line counts, and numbers that begin a line.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
PAGE_END = r"(?i)\f|\n---\s*Page\s+\d+\s*---\n?"
PAGE_MARK = "\n\n--- Page break ---\n\n"
GAP = re.compile(rf"\t+|[{SPACE}]{{3,}}")
THREE, TWO, COUNTED, FEWEST = 0.12, 0.18, 8, 4
NUMBERED = re.compile(r"\d{1,3}[).]")
TOLERANCE = 12.0


def parts_of(line: str) -> list[str]:
    return [p for p in (x.strip(SPACE) for x in GAP.split(line)) if p]


def column_count(lines: list[list[str]]) -> int:
    """Columns of a page by the parts of its long lines."""
    n = len(lines)
    if n < FEWEST:
        return 1
    if sum(len(p) >= 3 for p in lines) > THREE * n:
        return 3
    return 2 if sum(len(p) == 2 for p in lines) > TWO * n else 1


class Columns:
    """Columns of a page, filled line by line."""

    def __init__(self, n: int):
        self.held: list[list[str]] = [[] for _ in range(n)]

    def add(self, parts: list[str], line: str) -> None:
        """A line's parts, one for each column; a part alone goes on with the first column that
        is inside a paragraph, unless it begins with a number; others are the first column's."""
        n = len(self.held)
        if not parts:
            for c in self.held:
                c.append("")
        elif len(parts) >= n:
            for c, p in zip(self.held, parts):
                c.append(p)
        elif len(parts) == 1:
            c = next((c for c in self.held if c and c[-1]), self.held[0])
            if c and c[-1] and not NUMBERED.match(parts[0]):
                c[-1] += " " + parts[0]
            else:
                c.append(parts[0])
        else:
            self.held[0].append(line)

    def text(self) -> str:
        return "\n\n".join(t for t in ("\n".join(c).strip(SPACE) for c in self.held) if t)


def page_in_order(text: str | None) -> str | None:
    """A page's text, column after column; one without columns as it is."""
    if text is None:
        return None
    lines = [(line, parts_of(line)) for line in text.replace("\r\n", "\n").split("\n")]
    n = column_count([p for line, p in lines if len(line.strip(SPACE)) > COUNTED])
    if n < 2:
        return text.replace("\r\n", "\n").strip(SPACE)
    columns = Columns(n)
    for line, parts in lines:
        columns.add(parts, line.strip(SPACE))
    return columns.text()


reading_order = F.udf(page_in_order, returnType=StringType(), useArrow=True)


def documents_in_order(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """Documents (keys, text) in reading order: keys and text, with marks between pages.

    Pages are rows of their own, so that a long document is no task's alone.  Blank pages go; a
    document of one page is read whole.  Null and blank documents are empty.  Keys name a row.
    """
    pages = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), PAGE_END, -1), lambda p: F.btrim(p, F.lit(SPACE))), lambda p: p != "")
    d = docs.select(*keys, F.when(F.size(pages) > 1, pages).otherwise(F.array(F.coalesce(text, F.lit("")))).alias("pages"))
    p = d.select(*keys, F.posexplode("pages").alias("n", "page")).select(*keys, "n", reading_order("page").alias("page"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "page"))), lambda x: x["page"])
    return p.groupBy(*keys).agg(F.array_join(ordered, PAGE_MARK).alias("text"))


def first_fit(centres: list[float], tolerance: float) -> list[int]:
    """For each centre in turn the number of the first line whose first centre is near; else a new
    line.  First centres lie over the tolerance apart, so that three at most are near."""
    seeds: list[tuple[float, int]] = []
    out = []
    for c in centres:
        at = bisect_left(seeds, (c - tolerance, -1))
        near = []
        while at < len(seeds) and seeds[at][0] <= c + tolerance:
            near.append(seeds[at][1])
            at += 1
        out.append(min(near, default=len(seeds)))
        if not near:
            insort(seeds, (c, len(seeds)))
    return out


LINES = ArrayType(StructType([StructField("text", StringType())] + [StructField(n, DoubleType()) for n in ("y", "min_x", "max_x")]))


@F.udf(returnType=LINES, useArrow=True)
def _lines(words, tolerance):
    """Lines of a page's words, which come by their upper edge, top down."""
    centres = [(w["y0"] + w["y1"]) / 2 for w in words]
    held: dict[int, list[int]] = {}
    for i, line in enumerate(first_fit(centres, tolerance)):
        held.setdefault(line, []).append(i)
    out = []
    for own in held.values():
        by_x = sorted(own, key=lambda i: words[i]["x0"])
        text = re.sub(rf"[{SPACE}]+", " ", " ".join(words[i]["text"] for i in by_x)).strip(SPACE)
        out.append({"text": text, "y": centres[own[0]], "min_x": min(words[i]["x0"] for i in own), "max_x": max([0.0, *(words[i]["x1"] for i in own)])})
    return sorted(out, key=lambda r: r["y"])


def word_lines(words: DataFrame, *keys: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Recognised words (keys of a page, text, x0, y0, x1, y1) as lines: keys, line, text, y,
    min_x, max_x.

    Words come by upper edge, then left edge and text; each joins the first line whose first word's
    centre is within `tolerance`, else it begins one.  Blank words, and those without a place, are
    none; repeated words stay.  A page is one row; its words are as many as fit on a page.
    """
    good = words.where(F.btrim("text", F.lit(SPACE)) != "").dropna(subset=["x0", "y0", "x1", "y1"])
    boxes = F.struct(*(F.col(c).cast("double").alias(c) for c in ("y0", "x0")), "text", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1")))
    pages = good.groupBy(*keys).agg(F.array_sort(F.collect_list(boxes)).alias("words"))
    l = pages.select(*keys, F.posexplode(_lines("words", F.lit(float(tolerance)))).alias("line", "l"))
    return l.select(*keys, (F.col("line") + 1).alias("line"), "l.*")
