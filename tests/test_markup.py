"""Node tables, formulas, typed blocks and repairs: exact cases, generated trees, broken and long input."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gradus.functions import blocks, mathml
from gradus.sources import markup

R = "<m:r><m:t>{}</m:t></m:r>"
E = "<m:e>" + R + "</m:e>"
GOLDEN = [
    ("<m:oMath>\n <m:m> <m:mr>" + E.format(1) + E.format(2) + "</m:mr><m:mr>" + E.format(3) + E.format(4) + "</m:mr></m:m>\n</m:oMath>", r"$\begin{matrix}1 & 2 \\ 3 & 4\end{matrix}$"),
    ("<math><mtable><mtr><mtd><mn>5</mn></mtd><mtd><mn>6</mn></mtd></mtr> <mtr><mtd><mn>7</mn></mtd><mtd><mn>8</mn></mtd></mtr></mtable></math>", r"$\begin{matrix}5 & 6 \\ 7 & 8\end{matrix}$"),
    ('<m:oMath><m:d><m:dPr><m:begChr m:val="|"/><m:endChr m:val="|"/></m:dPr><m:e><m:m><m:mr>' + E.format("a") + E.format("b") + "</m:mr><m:mr>" + E.format("c") + E.format("d") + "</m:mr></m:m></m:e></m:d></m:oMath>", r"$\left| \begin{matrix}a & b \\ c & d\end{matrix} \right|$"),
    ('<m:oMath><m:nary><m:naryPr><m:chr m:val="∫"/></m:naryPr><m:sub>' + R.format("a") + "</m:sub><m:sup>" + R.format("b") + "</m:sup>" + E.format("f(x)dx") + "</m:nary></m:oMath>", r"$\int_{a}^{b} f(x)dx$"),
    ('<m:oMath><m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>' + R.format("i=1") + "</m:sub><m:sup>" + R.format("n") + "</m:sup>" + E.format("i") + "</m:nary></m:oMath>", r"$\sum_{i=1}^{n} i$"),
    ('<m:oMath><m:acc><m:accPr><m:chr m:val="→"/></m:accPr>' + E.format("F") + "</m:acc></m:oMath>", r"$\vec{F}$"),
    ("<math><mover><mi>A</mi><mo>→</mo></mover></math>", r"$\vec{A}$"),
    ("<m:oMath><m:eqarr>" + E.format("x + y = 5") + E.format("2x - y = 4") + "</m:eqarr></m:oMath>", r"$\begin{aligned}x + y = 5 \\ 2x - y = 4\end{aligned}$"),
    ("<math><mi>P</mi><mo>(</mo><mi>A</mi><mo>⋂</mo><mi>B</mi><mo>)</mo></math>", r"$P ( A \cap B )$"),
]
MORE = [
    ("<m:oMathPara><m:oMath>" + R.format("x") + "</m:oMath></m:oMathPara>", "\n$$x$$\n"),
    ("<m:oMath><m:f><m:num>" + R.format("1}") + "</m:num><m:den>" + R.format("2") + "</m:den></m:f></m:oMath>", "$1} 2$"),
    ("<m:oMath><m:f/></m:oMath>", r"$\frac{}{}$"),
    ("<m:oMath><m:sSubSup>" + E.format("x") + "<m:sub>" + R.format("i") + "</m:sub><m:sup>" + R.format("2") + "</m:sup></m:sSubSup><m:rad><m:deg/>" + E.format("y") + "</m:rad></m:oMath>", r"$x_{i}^{2}\sqrt[]{y}$"),
    ("<math><mfenced><mi>sin</mi><mi>abc</mi></mfenced><mo>&InvisibleTimes;</mo><munder><mo>lim</mo><mi>x</mi></munder></math>", r"$\left( \sin \text{abc} \right) \underset{x}{lim}$"),
    ("<math/>", None),
    ("no formula", None),
    ("<math>", None),
    ("<m:oMath></m:oMath>", "$$"),
]


@pytest.mark.parametrize("raw, want", GOLDEN + MORE)
def test_formulas(raw, want):
    spans = markup.formula_spans(raw)
    assert [mathml.formula(raw[a:b]) for a, b in spans] == ([] if want is None else [want])


def test_pages_with_formulas(spark):
    page = "<p>a " + " b ".join(x for x, _ in GOLDEN) + " <math> end</p>"
    d = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "x < y")], "id int, html string")
    got = {r.id: (r.page, r.all) for r in d.select("id", mathml.page_with_latex("html").alias("page"), mathml.formulas("html").alias("all")).collect()}
    assert got[1][0] == "<p>a " + " b ".join(x for _, x in GOLDEN) + " <math> end</p>"
    assert [x.latex for x in got[1][1]] == [x for _, x in GOLDEN]
    assert got[2] == (None, None) and got[3] == ("", []) and got[4] == ("x < y", [])


def made(rng, depth):
    """A random formula and, by recursion, its LaTeX and plain text."""
    kind = rng.choice(("t", "f", "sSup", "sSub", "rad", "nary", "d", "m", "acc", "seq")) if depth else "t"
    if kind == "t":
        x = rng.choice(("x", "12", "a+b", "}", "{y}", "é"))
        return R.format(x), x, x
    kids = [made(rng, depth - 1) for _ in range(rng.randrange(1, 5))]
    good = lambda tex, plain: tex if mathml.balanced(tex) else plain
    join = lambda *p: " ".join(x for x in p if x)
    if kind == "seq":
        xml, tex, plain = "".join(k[0] for k in kids), "".join(k[1] for k in kids), join(*(k[2] for k in kids))
        return f"<m:box>{xml}</m:box>", good(tex, plain), plain
    a, b = kids[0], kids[-1]
    if kind == "m":
        rows = [kids[: len(kids) // 2 or 1], kids[len(kids) // 2 :]]
        xml = "<m:m>" + "".join("<m:mr>" + "".join(f"<m:e>{k[0]}</m:e>" for k in r) + "</m:mr>" for r in rows) + "</m:m>"
        tex = "\\begin{matrix}" + " \\\\ ".join(" & ".join(k[1] for k in r) for r in rows) + "\\end{matrix}"
        plain = join(*(k[2] for r in rows for k in r))
    else:
        xml, tex, plain = {
            "f": (f"<m:f><m:num>{a[0]}</m:num><m:den>{b[0]}</m:den></m:f>", f"\\frac{{{a[1]}}}{{{b[1]}}}", join(a[2], b[2])),
            "sSup": (f"<m:sSup><m:e>{a[0]}</m:e><m:sup>{b[0]}</m:sup></m:sSup>", f"{a[1]}^{{{b[1]}}}", join(a[2], b[2])),
            "sSub": (f"<m:sSub><m:e>{a[0]}</m:e><m:sub>{b[0]}</m:sub></m:sSub>", f"{a[1]}_{b[1]}", join(a[2], b[2])),
            "rad": (f"<m:rad><m:deg>{b[0]}</m:deg><m:e>{a[0]}</m:e></m:rad>", f"\\sqrt[{b[1]}]{{{a[1]}}}", join(a[2], b[2])),
            "nary": (f'<m:nary><m:naryPr><m:chr m:val="∏"/></m:naryPr><m:sup>{b[0]}</m:sup><m:e>{a[0]}</m:e></m:nary>', f"\\prod^{{{b[1]}}} {a[1]}", join(b[2], a[2])),
            "d": (f'<m:d><m:dPr><m:begChr m:val="{{"/></m:dPr><m:e>{a[0]}</m:e></m:d>', f"\\left\\{{ {a[1]} \\right)", a[2]),
            "acc": (f'<m:acc><m:accPr><m:chr m:val="~"/></m:accPr><m:e>{a[0]}</m:e></m:acc>', f"\\overset{{~}}{{{a[1]}}}", a[2]),
        }[kind]
    return xml, good(tex, plain), plain


def test_generated_formulas():
    rng = random.Random(7)
    for _ in range(400):
        xml, tex, _ = made(rng, rng.randrange(1, 6))
        assert mathml.formula(f"<m:oMath>{xml}</m:oMath>") in (f"${tex.strip()}$", tex if tex.startswith("$") else None)


def test_xml_round_trip(spark):
    rows = [(i, x) for i, (x, _) in enumerate(GOLDEN)] + [(100, None), (101, ""), (102, "<a b='1' c=\"x y\"><d/>t &amp; u<e></e></a><f/>")]
    d = spark.createDataFrame(rows, "id int, xml string")
    got = {r.id: r.again for r in markup.with_nodes(d, markup.xml_nodes, "xml", "id").select("id", markup.written(F.col("nodes")).alias("again")).collect()}
    for i, x in rows:
        assert got[i] == (x if x is None else re.sub(r">\s+", ">", x).strip())


def test_broken_xml_has_errors(spark):
    rows = [(1, "<a><b>x</a>"), (2, "<a>"), (3, "</a><b/>"), (4, "<a><b></c></a>"), (5, "<a <b"), (6, "text only"), (7, "<a><!-- no end <b/></a>")]
    d = spark.createDataFrame(rows, "id int, xml string")
    n = markup.node_table(d, markup.xml_nodes, "xml", "id")
    errors = {(r.id, r.name, r.error) for r in n.where("error is not null").collect()}
    assert errors == {(1, "b", "ended by </a>"), (1, "a", "unclosed"), (2, "a", "unclosed"), (3, "#stray", "end without start"), (4, "b", "ended by </c>"), (5, "#stray", "tag without end")}
    assert {r.id for r in n.collect()} == {1, 2, 3, 4, 5, 7}


LONG = ["<b>", "<a><b>", "<!--", "<p>", "<", "</p>", "<div><p>", "<td>", "<script>", "<li><b>", "<dd><b>", "<p><td><b><div>", "<math>", "<math></p>", "&", "<i></i>", "<b><p></p>"]


@pytest.mark.parametrize("piece", LONG)
def test_long_markup_takes_linear_time(piece):
    """100,000 unclosed or stray elements: seconds, however they nest."""
    text, start = piece * 100_000, time.perf_counter()
    markup.parsed(text), markup.parsed(text, html=True), markup.mended(text), markup.formula_spans(text)
    assert time.perf_counter() - start < 30


def ends_match(html):
    """Whether every element ends once, in order."""
    stack = []
    for m in re.finditer(r"<!--[\s\S]*?-->|<(/?)([a-zA-Z][^\s/>]*)[^>]*?(/?)>", re.sub(r"(?is)(<(script|style|title|textarea)\b[^>]*>).*?(</\2)", r"\1\3", html)):
        if not m[2] or m[3] or m[2].lower() in markup.VOID:
            continue
        if not m[1]:
            stack.append(m[2].lower())
        elif not stack or stack.pop() != m[2].lower():
            return False
    return not stack


def test_repairs():
    cases = {
        "<p>a <b>c</b></p>": ("<p>a <b>c</b></p>", 0, 0, 0, 0),
        "<p>a <b>c</p>": ("<p>a <b>c</b></p>", 0, 1, 0, 0),
        "<div><p>x": ("<div><p>x</p></div>", 2, 0, 0, 0),
        "x</b> y</p>": ("x y", 0, 0, 2, 0),
        "<p>a<span> <i></i></span>b<b><img></b></p>": ("<p>ab<b><img></b></p>", 0, 0, 0, 2),
        "<BR><P >x</P >": ("<BR><P >x</P >", 0, 0, 0, 0),
        "a < b & c": ("a < b & c", 0, 0, 0, 0),
        "": ("", 0, 0, 0, 0),
    }
    for html, want in cases.items():
        assert tuple(markup.mended(html).values()) == want, html
    assert markup.mended(None) is None


def test_repaired_markup_always_balances():
    rng = random.Random(11)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<div class='x'>", "</div>", "<br>", "<img src=a>", "text ", "<!-- c -->", "<i/>", "</i>", "<table>", "<td>", "</table>", "<script>a<b</script>", "< ", "&amp;"]
    for _ in range(600):
        html = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25)))
        once = markup.mended(html)
        assert ends_match(once["html"]), html
        again = markup.mended(once["html"])
        assert again["html"] == once["html"] and not any(v for k, v in again.items() if k != "html"), html
        if ends_match(html) and not once["empty"]:
            assert once["html"] == html


FIRST = """<p class="MsoNormal">If <span><math><mo>P</mo><mo>(</mo><mo>A</mo><mo>∪</mo><mo>B</mo><mo>)</mo><mo>=</mo><mn>0.8</mn></math></span> and <math><mo>P</mo><mo>(</mo><mo>A</mo><mo>)</mo></math>, find it.</p>
 <p class="MsoNormal">(A) 0.5</p><p>(B) 0.4</p><p>(C) 0.3</p><p>(D) 0.2</p>"""
SECOND = """<p>Consider the following:</p><table border="1"><tr><td><b>Trial</b></td><td>Value x</td><td>Result y</td></tr>
<tr><td>1</td><td>0.5</td><td>1.2</td></tr><tr><td>2</td><td>1.0</td><td>2.4</td></tr></table><p>Determine the relation.</p>"""
THIRD = """<p>Which are properties?</p><ul><li>High melting point</li><li>Poor conductivity</li><li>Directional bonding</li></ul><p>(A) 1 and 2</p><p>(B) 2 and 3</p><p>(C) 1 and 3</p><p>(D) All</p>"""


def test_typed_blocks(spark):
    rows = [(1, FIRST), (2, SECOND), (3, THIRD), (4, None), (5, ""), (6, "bare text"), (7, "<table><tr><td>(a) x<td>b. <i>y</i></table><p>goes on<p>2) next"), (8, "<p><o:p>&nbsp;</o:p></p><p>a <o:p>gone</o:p>b<script>x</script></p><img src=x>")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "id int, html string, kind string")
    got = {}
    for r in blocks.page_blocks(d, "html", "id").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.kind, r.label, r.text))
    options = lambda *x: [("option", "ABCD"[i], f"({'ABCD'[i]}) {t}") for i, t in enumerate(x)]
    assert got.pop(1) == [("paragraph", None, "If  $P ( A ∪ B ) = 0.8$  and $P ( A )$, find it."), *options("0.5", "0.4", "0.3", "0.2")]
    assert got.pop(2) == [("paragraph", None, "Consider the following:"), ("table", None, "Trial\tValue x\tResult y\n1\t0.5\t1.2\n2\t1.0\t2.4"), ("paragraph", None, "Determine the relation.")]
    assert got.pop(3) == [("paragraph", None, "Which are properties?"), ("list_item", None, "* High melting point"), ("list_item", None, "* Poor conductivity"), ("list_item", None, "* Directional bonding"), *options("1 and 2", "2 and 3", "1 and 3", "All")]
    assert got.pop(7) == [("option", "A", "(A) x"), ("option", "B", "(B) y \ngoes on"), ("paragraph", None, "2) next")]
    assert got.pop(8) == [("paragraph", None, "a b")]
    assert not got


def test_blocks_of_plain_text(spark):
    d = spark.createDataFrame([(1, "1. What?\nA) one\n(b) two\r\ngoes on\n(A) more\n\n2. Next"), (2, "a\n\nb"), (3, None)], "id int, text string")
    b = blocks.joined_blocks(blocks.plain_units(d, "id"), "id")
    got = {r.id: r.text for r in blocks.plain_text(b, "id").collect()}
    assert got == {1: "1. What?\n\n(A) one more\n\n(B) two\ngoes on\n\n2. Next", 2: "a\n\nb"}


def test_containers_are_opened(spark):
    html = "<body><nav><ul><li>x</ul></nav><div><article><h1>T</h1><p>a<div>b<span>c</span></div></article></div></body>"
    d = spark.createDataFrame([(1, html)], "id int, html string")
    got = [(r.kind, r.text) for r in blocks.page_blocks(d, "html", "id", into=blocks.CONTAINERS).orderBy("place").collect()]
    assert got == [("list_item", "* x"), ("paragraph", "T"), ("paragraph", "a"), ("paragraph", "b c")]
    assert blocks.page_blocks(d, "html", "id").count() == 2


def test_formulas_are_folded_while_they_are_read():
    """The same as of parsed nodes, in less than half the time."""
    row = "<m:mr><m:e>" + R.format(7) + "</m:e><m:e><m:f><m:fPr/><m:num>" + R.format(1) + "</m:num><m:den>" + R.format(2) + "</m:den></m:f></m:e></m:mr>"
    raw = "<m:oMath><m:d><m:e><m:m>" + row * 200 + "</m:m></m:e></m:d></m:oMath>"
    for x in [raw, "<m:oMath><m:r><m:t> a</m:t></m:r> b<c/></m:oMath><d/>", "<m:r><m:t> a</m:t></m:r><b/>", "</a><m:r>\n<m:t>x"]:
        assert mathml._markup_latex(x) == mathml.latex_of(markup.parsed(x))

    def seconds(f):
        start = time.perf_counter()
        for _ in range(10):
            f(raw)
        return time.perf_counter() - start

    assert min(seconds(mathml.formula) for _ in range(3)) * 2 < min(seconds(lambda x: mathml.latex_of(markup.parsed(x))) for _ in range(3))


def test_tables_take_time_in_proportion_to_their_cells(spark):
    """4,000 cells of one table: its text is made once, not for each cell."""
    row = "<tr><td>a{0}</td><td>b{0}</td></tr>"
    d = spark.createDataFrame([(1, "<table>" + "".join(row.format(i) for i in range(2000)) + "</table>")], "id int, html string")
    start = time.perf_counter()
    got = blocks.page_blocks(d, "html", "id").collect()
    assert [r.text for r in got] == ["\n".join(f"a{i}\tb{i}" for i in range(2000))]
    assert time.perf_counter() - start < 30


def test_number_of_options_is_not_made_anew_for_each_cell(spark):
    """It is an aggregate: no filter over a block's rows goes over them again for each row."""
    d = spark.createDataFrame([(1, "<table><tr><td>(a) x<td>(b) y<td>z</table><p>(c) w</p>")], "id int, html string")
    u = blocks.units(markup.with_nodes(d, markup.html_nodes, "html", "id", fields=blocks.FIELDS), "id")
    assert [tuple(r) for r in u.orderBy("pos").select("kind", "label", "content").collect()] == [("option", "A", "x"), ("option", "B", "y"), ("option", "C", "w")]
    plan = u._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if re.match(r"\W*Filter ", line)]
    assert filters and not [line for line in filters if "filter(rows" in line]
