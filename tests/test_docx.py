"""Word files, made here."""

import zipfile

from gradus.operators.cleaning import plain_blocks
from gradus.sources import docx

P = "<w:p>{0}<w:r><w:t>{1}</w:t></w:r></w:p>"
NUM = '<w:pPr><w:numPr><w:ilvl w:val="{0}"/><w:numId w:val="{1}"/></w:numPr></w:pPr>'


def _file(at, body):
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_reading_order_and_list_numbers(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + P.format("", "a") + "</w:tc><w:tc>" + P.format("", "b &amp; c") + "</w:tc></w:tr></w:tbl>"
    body = P.format("", "Intro") + P.format("", "SECTION B") + P.format(NUM.format(0, 7), "First one?") + P.format(NUM.format(1, 7), "inner") + table + P.format("", "") + P.format(NUM.format(0, 7), "Next one?") + P.format(NUM.format(0, 7), "9. kept") + P.format(NUM.format(0, 8), "other list")
    _file(tmp_path / "a.docx", body)
    _file(tmp_path / "empty.docx", "")
    (tmp_path / "broken.docx").write_bytes(b"PK no archive")
    read = docx.paragraphs(spark, f"file://{tmp_path}")
    errors = [r.path.rsplit("/", 1)[-1] for r in read.where("error is not null").collect()]
    assert errors == ["broken.docx"]
    got = [(r.section, r.line) for r in docx.lines(read).orderBy("pos").collect()]
    assert got == [("General", "Intro"), ("Section B", "SECTION B"), ("Section B", "1. First one?"), ("Section B", "1. inner"), ("Section B", "[TABLE]\na | b & c"), ("Section B", "2. Next one?"), ("Section B", "9. kept"), ("Section B", "1. other list")]
    assert docx.texts(read).count() == 1


def test_blocks_of_a_file(spark, tmp_path):
    _file(tmp_path / "a.docx", "".join(P.format("", x) for x in ("1. What is heat?", "A: energy", "B: a fluid", "2. Why?")))
    text = docx.texts(docx.paragraphs(spark, f"file://{tmp_path}")).withColumnRenamed("path", "id")
    got = [(r.number, r.stem, r.options) for r in plain_blocks(text).orderBy("block").collect()]
    assert got == [(1, "What is heat?", "a:energy|b:a fluid"), (2, "Why?", "")]


def test_pages_and_images(spark):
    """HTML of a file: headings, lists, nested tables, marks, images by reference; broken files."""
    pic = '<w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r>'
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' + run("A &lt; B") + "</w:p>" + f"<w:p>{run('x', '<w:b/><w:i/>')}{run('2', '<w:vertAlign w:val=\"subscript\"/>')}<w:r><w:tab/><w:br/></w:r>{pic}</w:p><w:p></w:p>"
    body += "".join(f"<w:p>{NUM.format(0, 1)}{run(x)}</w:p>" for x in ("one", "two")) + f"<w:tbl><w:tr><w:tc><w:p>{run('c')}</w:p>{pic and '<w:p>' + pic + '</w:p>'}</w:tc></w:tr></w:tbl>" + "<w:p>" + pic.replace("r1", "r7") + "</w:p>"
    rows = [("a", body, b"\x89PNG"), ("none", body, None), ("empty", "", None), ("null", None, None)]
    d = spark.createDataFrame(rows, "path string, body string, image binary").select("path", docx.packed("body", "image").alias("content"))
    read = docx.pages(d)
    got = {r.path: r for r in read.collect()}
    html = "<h1>A &lt; B</h1><p><strong><em>x</em></strong><sub>2</sub>\t<br/>{0}</p><ol><li>one</li><li>two</li></ol><table><tr><td><p>c</p>{1}</td></tr></table>"
    assert got["a"].html == html.format('<img src="image-1.png">', '<p><img src="image-2.png"></p>')
    assert got["none"].html == html.format("", "") and got["none"].images == [] and got["empty"].html == ""
    assert got["null"].error.startswith("BadZipFile")
    shown = [(r.path, r.place, r.name, bytes(r.content)) for r in docx.images(read).orderBy("place").collect()]
    assert shown == [("a", 1, "image-1.png", b"\x89PNG"), ("a", 2, "image-2.png", b"\x89PNG")]


def test_large_files_are_read_row_by_row():
    """A file's nodes are given while it is read: few are held at a time."""
    import tracemalloc

    row = "<w:tr><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc></w:tr>"
    body = "".join(f"<w:p><w:r><w:t>{i}</w:t></w:r></w:p>" for i in range(20_000)) + "<w:tbl>" + "".join(map(row.format, range(20_000))) + "</w:tbl>"
    content = docx._packed(body, None)
    tracemalloc.start()
    said = [len(r["text"]) for r in docx._rows("a", content)]
    rows_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    html = docx._Page(content).html
    peak = max(rows_peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert len(said) == 20_001 and said[-1] == len("[TABLE]") + sum(len(f"\n{i}") for i in range(20_000))
    assert html.count("<tr>") == 20_000 and html.endswith("</table>")
    assert peak < 12 << 20
