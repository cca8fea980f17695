"""Reading order, lines of words, drawings and JSON of models: brute force and edge cases."""

import random

from gradus.functions import layout, office
from gradus.operators import payloads


def slow_first_fit(centres, tolerance):
    seeds, out = [], []
    for c in centres:
        i = next((i for i, s in enumerate(seeds) if abs(s - c) <= tolerance), len(seeds))
        if i == len(seeds):
            seeds.append(c)
        out.append(i)
    return out


def test_first_fit():
    rng = random.Random(1)
    for _ in range(500):
        centres = [rng.choice((rng.random() * 200, rng.randrange(0, 200, 6))) for _ in range(rng.randrange(0, 40))]
        assert layout.first_fit(centres, 12) == slow_first_fit(centres, 12)
    assert len(set(layout.first_fit([i * 13.0 for i in range(100_000)], 12))) == 100_000


def test_word_lines(spark):
    rows = [(1, "b", 50.0, 10.0, 60.0, 20.0), (1, "a", 5.0, 12.0, 15.0, 22.0), (1, " ", 0.0, 10.0, 1.0, 20.0), (1, "far", 0.0, 40.0, 9.0, 50.0), (1, "twice", 0.0, 80.0, 9.0, 90.0), (1, "twice", 0.0, 80.0, 9.0, 90.0), (1, None, 0.0, 0.0, 0.0, 0.0), (1, "lost", None, 0.0, 0.0, 0.0), (2, "  ", 0.0, 0.0, 0.0, 0.0), (None, "x  y", 1.0, 1.0, 2.0, 2.0)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page int, text string, x0 double, y0 double, x1 double, y1 double, line string")
    got = [tuple(r) for r in layout.word_lines(d, "page").orderBy("page", "line").collect()]
    assert got == [(None, 1, "x y", 1.5, 1.0, 2.0), (1, 1, "a b", 15.0, 5.0, 60.0), (1, 2, "far", 45.0, 0.0, 9.0), (1, 3, "twice twice", 85.0, 0.0, 9.0)]
    assert layout.word_lines(d.limit(0), "page").count() == 0


def test_columns():
    two = "\n".join(f"left text {i}    right text {i}" for i in range(6))
    lefts, rights = ("\n".join(f"{s} text {i}" for i in range(6)) for s in ("left", "right"))
    assert layout.page_in_order(two) == f"{lefts}\n\n{rights}"
    assert layout.page_in_order("Title of it\n" + two) == f"Title of it\n{lefts}\n\n{rights}"
    assert layout.page_in_order(two + "\ngoes on here") == f"{lefts} goes on here\n\n{rights}"
    assert layout.page_in_order(two + "\n7) a new one") == f"{lefts}\n7) a new one\n\n{rights}"
    three = "\n".join(f"a{i} long enough\tb{i}\tc{i}" for i in range(5)) + "\nhalf    line"
    assert layout.page_in_order(three) == "\n".join(f"a{i} long enough" for i in range(5)) + "\nhalf    line\n\nb0\nb1\nb2\nb3\nb4\n\nc0\nc1\nc2\nc3\nc4"
    for plain in ("", "one line", "a    b\nc    d", "no columns in this\n" * 9):
        assert layout.page_in_order(plain) == plain.strip()
    assert layout.page_in_order(None) is None


def made_page(rng):
    """A page of cells and what its columns hold."""
    n = rng.randrange(1, 4)
    cells = [[f"w{rng.randrange(99)} and words {i}" for _ in range(n)] for i in range(rng.randrange(5, 30))]
    page = "\n".join(rng.choice(("    ", "\t", " \t\t ")).join(row) for row in cells)
    return page, "\n\n".join("\n".join(c) for c in zip(*cells))


def test_generated_pages(spark):
    rng = random.Random(5)
    docs = [(i, [made_page(rng) for _ in range(rng.randrange(1, 4))]) for i in range(40)]
    rows = [(i, rng.choice(("\f", "\n--- Page 3 ---\n")).join(p for p, _ in pages)) for i, pages in docs] + [(100, None), (101, " \f ")]
    d = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.text for r in layout.documents_in_order(d, "text", "id").collect()}
    assert got.pop(100) == "" and got.pop(101).strip() == ""
    assert got == {i: "\n\n--- Page break ---\n\n".join(want for _, want in pages) for i, pages in docs}


def test_drawings(spark):
    rows = [(1, None), (2, ""), (3, "<img src=a.png>"), (4, '<img v:shapes="x" src="a.png" alt="A dog here"><v:shape id=x><v:shape id="y"><v:imagedata o:title="p=1"/></v:shape></v:shape>'), (5, "<v:shape><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></v:shape>")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "id int, html string, shape string")
    got = {(r.id, r.shape): (r.place, r.kind, r.origin, r.value, r.caption) for r in office.drawings(d, "html", "id").collect()}
    assert got == {(4, "x"): (1, "figure", None, "a.png", "A dog here"), (4, "y"): (2, "formula", "vml", "p=1", None)}


def test_json_of_models(spark):
    cases = [
        ('{"stem":"s"}', ("DESCRIPTIVE", "s", [], [], "", [], [])),
        ("text", (None,) * 6 + (["json"],)),
        (None, (None,) * 6 + (["json"],)),
        ("", (None,) * 6 + (["json"],)),
        ("[1]", (None,) * 6 + (["object"],)),
        ("null", (None,) * 6 + (["object"],)),
        ('a {"stem":null,"options":"x","correctAnswers":null,"tags":["a",null]} b', ("DESCRIPTIVE", None, None, None, "", None, ["stem", "options", "correctAnswers", "tags"])),
        ('{"options":["a",{"latex":"y"},{"text":"b","image":null}],"correctAnswers":"B","explanation":"e","tags":[]}', ("DESCRIPTIVE", "", [("a", None, None), ("", "y", None), ("b", None, None)], ["B"], "e", [], [])),
        ('{"options":[{"text":null}],"questionType":7}', (None, "", None, [], "", [], ["questionType", "options"])),
        ('{"options":[null]}', ("DESCRIPTIVE", "", None, [], "", [], ["options"])),
    ]
    d = spark.createDataFrame([(i, r, "x") for i, (r, _) in enumerate(cases)], "id int, raw string, v string")
    for r in payloads.questions(d, "raw", "id").collect():
        plain = lambda x: [tuple(o) if not isinstance(o, str) else o for o in x] if isinstance(x, list) else x
        assert tuple(plain(x) for x in r[1:]) == cases[r.id][1], cases[r.id][0]
