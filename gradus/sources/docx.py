"""Word files as tables of paragraphs, and their text in reading order."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html import escape
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.intake import LISTED_NUMBER, section_name

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ROW = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("text", pa.string()), ("is_table", pa.bool_()), ("num_id", pa.string()), ("level", pa.string()), ("error", pa.string())])
PARAGRAPH = "path string, pos bigint, text string, is_table boolean, num_id string, level string, error string"


def _text(node: ET.Element) -> str:
    said = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: "\n"}
    return "".join(said[x.tag](x) for x in node.iter() if x.tag in said).strip()


DOCUMENT = "word/document.xml"
#: Rows that are given at once.
ROWS = 5000


class _Nothing:
    """What a parser builds that only looks for errors."""

    def close(self) -> None:
        pass


def _sound(z: zipfile.ZipFile) -> None:
    """Raise what is wrong with a file's document; it is read through and nothing of it is held."""
    parser = ET.XMLParser(target=_Nothing())
    with z.open(DOCUMENT) as f:
        while some := f.read(1 << 20):
            parser.feed(some)
    parser.close()


def _nodes(z: zipfile.ZipFile) -> Iterator[tuple[int, str, ET.Element | None]]:
    """What stands in a file's body, in order: place, and `block` with its element, or `table`, each
    `row` with its element, and `end`.  What was given is let go, so that a file is never held whole."""
    depth, body, pos, top = 0, None, -1, None
    with z.open(DOCUMENT) as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                depth += 1
                if depth == 2 and body is None and e.tag == f"{_W}body":
                    body = top = e
                elif depth == 3 and top is not None:
                    pos, top = pos + 1, e
                    if e.tag == f"{_W}tbl":
                        yield pos, "table", None
                continue
            depth -= 1
            if top is None:
                continue
            if depth == 3 and top.tag == f"{_W}tbl":
                for r in e.iter(f"{_W}tr"):
                    yield pos, "row", r
                top.clear()
            elif depth == 2:
                yield (pos, "end", None) if e.tag == f"{_W}tbl" else (pos, "block", e)
                body.clear()
                top = body
            elif depth == 1:
                top = None


def _rows(path: str, content: bytes) -> Iterator[dict]:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        _sound(z)
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        yield {"path": path, "pos": 0, "error": f"{type(e).__name__}: {e}"}
        return
    table = io.StringIO()
    for pos, what, node in _nodes(z):
        if what == "table":
            table = io.StringIO()
            table.write("[TABLE]")
        elif what == "row":
            table.write("\n" + " | ".join(_text(c) for c in node.iter(f"{_W}tc")))
        elif what == "end":
            said = table.getvalue()
            yield {"path": path, "pos": pos, "text": said if "\n" in said else said + "\n", "is_table": True}
        elif node.tag == f"{_W}p" and (text := _text(node)):
            of = lambda name: node.find(f"{_W}pPr/{_W}numPr/{_W}{name}")  # noqa: B023, E731
            num, level = of("numId"), of("ilvl")
            value = None if num is None else num.get(f"{_W}val")
            yield {"path": path, "pos": pos, "text": text, "is_table": False, "num_id": value, "level": None if value is None else "0" if level is None else level.get(f"{_W}val")}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = _rows(path.as_py(), content.as_py())
            while some := list(islice(rows, ROWS)):
                yield pa.RecordBatch.from_pylist(some, _ROW)


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and tables of the folder's Word files in order (`PARAGRAPH`).

    Empty paragraphs are left out; a file that cannot be read is one row with `error`.
    """
    return paragraphs_of(files(spark, folder))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of a folder's Word files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder).select("path", "content")


def paragraphs_of(read: DataFrame) -> DataFrame:
    """As `paragraphs`, of files (path, content) from anywhere."""
    return read.select("path", "content").mapInArrow(_read, PARAGRAPH)


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: What a run's properties are in HTML, outermost first.
MARKS = (("b", "strong"), ("i", "em"))
RAISED = {"superscript": "sup", "subscript": "sub"}
PAGE = "path string, html string, images array<struct<name:string,content:binary>>, error string"
_PAGE = pa.schema([("path", pa.string()), ("html", pa.string()), ("images", pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary())]))), ("error", pa.string())])


def _on(node: ET.Element | None) -> bool:
    return node is not None and node.get(f"{_W}val") not in ("0", "false", "none")


def _inner(cell: ET.Element) -> Iterator[tuple[int, str, ET.Element | None]]:
    """What stands in a cell, as `_nodes`."""
    for pos, n in enumerate(cell):
        if n.tag != f"{_W}tbl":
            yield pos, "block", n
            continue
        yield pos, "table", None
        for r in n.iter(f"{_W}tr"):
            yield pos, "row", r
        yield pos, "end", None


class _Page:
    """A Word file as HTML; the images it shows, in order."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        _sound(self.zip)
        name = "word/_rels/document.xml.rels"
        rels = ET.fromstring(self.zip.read(name)).iter(_REL) if name in self.zip.namelist() else ()
        self.targets = {r.get("Id"): r.get("Target") for r in rels}
        self.images: list[dict] = []
        self.html = self._written(_nodes(self.zip))

    def _written(self, nodes) -> str:
        out, listed = io.StringIO(), False
        for _, what, n in nodes:
            item = what == "block" and n.tag == f"{_W}p" and n.find(f"{_W}pPr/{_W}numPr") is not None
            if item != listed:
                out.write("<ol>" if item else "</ol>")
                listed = item
            if what == "row":
                out.write("<tr>" + "".join(f"<td>{self._written(_inner(c))}</td>" for c in n.iter(f"{_W}tc")) + "</tr>")
            elif what != "block":
                out.write("<table>" if what == "table" else "</table>")
            elif n.tag == f"{_W}p" and (said := "".join(map(self._run, n.iter(f"{_W}r")))):
                style = n.find(f"{_W}pPr/{_W}pStyle")
                head = re.fullmatch(r"Heading([1-6])", style.get(f"{_W}val", "") if style is not None else "")
                tag = "li" if item else f"h{head[1]}" if head else "p"
                out.write(f"<{tag}>{said}</{tag}>")
        return out.getvalue() + ("</ol>" if listed else "")

    def _run(self, r: ET.Element) -> str:
        parts = []
        for n in r.iter():
            if n.tag == f"{_W}t":
                parts.append(escape(n.text or "", quote=False))
            elif n.tag == f"{_W}tab":
                parts.append("\t")
            elif n.tag == f"{_W}br":
                parts.append("<br/>")
            elif n.tag == f"{_A}blip":
                parts.append(self._image(n.get(f"{_R}embed")))
        said = "".join(parts)
        raised = r.find(f"{_W}rPr/{_W}vertAlign")
        tags = [html for name, html in MARKS if _on(r.find(f"{_W}rPr/{_W}{name}"))]
        tags += [RAISED[v] for v in [raised.get(f"{_W}val") if raised is not None else None] if v in RAISED]
        return said and "".join(f"<{t}>" for t in tags) + said + "".join(f"</{t}>" for t in reversed(tags))

    def _image(self, ref: str | None) -> str:
        target = self.targets.get(ref)
        if not target or f"word/{target}" not in self.zip.namelist():
            return ""
        name = f"image-{len(self.images) + 1}.{target.rpartition('.')[2].lower()}"
        self.images.append({"name": name, "content": self.zip.read(f"word/{target}")})
        return f'<img src="{name}">'


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            row = {"path": path.as_py()}
            try:
                page = _Page(content.as_py() or b"")
                row |= {"html": page.html, "images": page.images}
            except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                row["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([row], _PAGE)


def pages(read: DataFrame) -> DataFrame:
    """Word files (path, content) as HTML (`PAGE`): paragraphs, headings, numbered items, tables,
    raised, lowered, bold and slanted text, and their images, numbered as they are shown.  A file
    that cannot be read is a row with `error`; an image whose file is missing is left out."""
    return read.select("path", "content").mapInArrow(_pages, PAGE)


def images(read: DataFrame) -> DataFrame:
    """path, place, name and content of the images that files show, a row each, to be written."""
    return read.select("path", F.posexplode("images").alias("at", "i")).select("path", (F.col("at") + 1).alias("place"), "i.name", "i.content")


_XMLNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


_PIECE = pa.schema([("path", pa.string()), ("piece", pa.string()), ("image", pa.binary())])


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (path, content) of pieces in order (path, piece, image)."""
    path, out = None, None

    def begun():
        z = zipfile.ZipFile(io.BytesIO(), "w", zipfile.ZIP_DEFLATED)
        f = z.open(DOCUMENT, "w", force_zip64=True)
        f.write(f"<w:document {_XMLNS}><w:body>".encode())
        return z, f, z.fp

    def ended(image):
        z, f, held = out
        f.write(b"</w:body></w:document>")
        f.close()
        if image is not None:
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{_REL[1:].partition("}")[0]}"><Relationship Id="r1" Target="media/a.PNG"/></Relationships>')
            z.writestr("word/media/a.PNG", image)
        z.close()
        return pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "content": pa.array([held.getvalue()], pa.binary())})

    shown = None
    for batch in batches:
        for p, piece, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != path:
                if out:
                    yield ended(shown)
                path, out, shown = p, begun(), None
            if piece is not None:
                out[1].write(piece.encode())
            shown = image if shown is None else shown
    if out:
        yield ended(shown)


def packed_files(pieces: DataFrame, *order: str) -> DataFrame:
    """Word files (path, content) of pieces of their bodies' markup (path, piece, image) in an
    order; an image is shown by the reference r1.  Pieces without a path are none.

    A file is written piece by piece, so that a task holds no body, only what it packed of one."""
    dealt = pieces.where("path is not null").repartition("path").sortWithinPartitions("path", *order, "piece")
    return dealt.select("path", "piece", "image").mapInArrow(_packing, "path string, content binary")


def _packed(body: str | None, image: bytes | None) -> bytes | None:
    if body is None:
        return None
    return next(_packing([pa.RecordBatch.from_pylist([{"path": "", "piece": body, "image": None if image is None else bytes(image)}], _PIECE)])).column(1)[0].as_py()


#: A Word file of a body's markup, and an image that it may show by the reference r1.
packed = F.udf(_packed, returnType=BinaryType(), useArrow=True)


def lines(read: DataFrame) -> DataFrame:
    """path, pos, section, line: paragraphs with the number that their list gives them.

    Each list counts on at each of its levels; a paragraph that begins with a number keeps it.
    A header opens a section, and the lines that follow belong to it; before it they are General.
    """
    p = read.where("error is null").withColumn("header", F.when(~F.col("is_table"), section_name(F.col("text"))))
    own = Window.partitionBy("path", "num_id", "level").orderBy("pos")
    listed = F.col("num_id").isNotNull() & F.col("header").isNull()
    n = F.count_if(listed).over(own)
    number = F.when(listed & ~F.col("text").rlike(LISTED_NUMBER) & (F.regexp_extract("text", r"(?i)^(?:Q(?:uestion)?\s*)?(\d{1,3})\b", 1) != n.cast("string")), F.concat(n.cast("string"), F.lit(". "))).otherwise("")
    above = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last("header", ignorenulls=True).over(above), F.lit("General"))
    return p.select("path", "pos", section.alias("section"), F.concat(number, "text").alias("line"))


def texts(read: DataFrame) -> DataFrame:
    """path and body, the text of each file in reading order."""
    l = lines(read).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return l.select("path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))
