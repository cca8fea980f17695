"""Archives and HTML."""

import hashlib
import struct
from collections import Counter

import zstandard

from gradus.llm import mainhtml, warc


def pages(spark):
    big = "<p>" + "word " * 400 + "</p>"
    rows = [(1, "http://a/é x", big), (2, None, big), (3, "http://b", None), (4, "http://b", ""), (5, "http://c", "<p>small</p>"), (6, "u", "<p>small</p>"), (7, "u", big + "é😀"), (7, "u", big + "é😀"), (None, "n", big), (9, "u", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id bigint, url string, html string, digest string, records string")


def test_round_trip(spark, tmp_path):
    p = pages(spark)
    folder = f"file://{tmp_path}/w"
    assert sum(r.records for r in warc.write(warc.plan(p), folder, warc.train_dictionary(p)).collect()) == p.count()
    got = warc.read(spark, folder).collect()
    want = Counter((r.page_id, r.html or "") for r in p.collect())
    assert all(r.error is None for r in got)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter({(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()): n for (i, h), n in want.items()})
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == ("revisit", 2) and kinds[2] == ("response", None) and kinds[None] == ("revisit", 2)
    assert kinds[5] == kinds[6] == ("response", None)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest


def test_empty(spark, tmp_path):
    p = pages(spark).limit(0)
    assert warc.train_dictionary(p) == b""
    assert warc.plan(p).count() == 0


def test_frames_and_faults():
    good = warc.record(1, "http://a", b"payload", "response", None)
    words = zstandard.train_dictionary(2000, [f"WARC/1.1 sample {i} text {i * 7} of a record".encode() * 3 for i in range(400)]).as_bytes()
    for lead, d in ((b"", None), (struct.pack("<II", warc.SKIPPABLE_DICTIONARY, len(words)) + words, zstandard.ZstdCompressionDict(words))):
        c = zstandard.ZstdCompressor(dict_data=d)
        archive = lead + c.compress(good) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + c.compress(good)
        assert list(warc.frames(archive)) == [good, good]
        cut = list(warc.frames(archive[:-3]))
        assert cut[0] == good and isinstance(cut[-1], str)
    assert warc.parse(good)["error"] is None
    assert warc.parse(good[:-4])["error"].startswith("length")
    assert warc.parse(good.replace(b"payload", b"paylood"))["error"].startswith("digest")
    assert warc.parse(b"nonsense")["error"].startswith("header")
    assert warc.parse(good.replace(b"WARC-Date", b"WARC-Dote"))["error"] == "header: warc-date"


LONG = "It is one of the things that we have to say about the way in which this was done, and that is all of it."


def test_html():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a> <a>News</a></nav><div class="cookie-banner">We use cookies on this site and you have to accept them all now.</div>
    <article><h1>A &amp; B</h1><p>{LONG}</p><p>Two&nbsp;<b>bold</b> &eacute;\n\n words.<p>{LONG}<script>var x = "<p>no</p>";</script></article>
    <aside>{LONG}</aside><div class="comments"><p>{LONG}</p></div><footer>Imprint {LONG}</footer></body></html>"""
    text = mainhtml.main_text(page)
    assert text == f"A & B\n\n{LONG}\n\nTwo bold é words.\n\n{LONG}"
    assert mainhtml.main_text("") == "" and mainhtml.main_text("<nav>" + "<a>x</a>" * 9) == ""
    assert mainhtml.main_text("<div>" * 5000 + LONG) == LONG


def test_extract(spark):
    got = {r.page_id: r for r in mainhtml.extract(pages(spark)).collect()}
    assert got[3].text == got[4].text == "" and got[3].n_chars == 0
    assert got[1].text == ("word " * 400).strip()  # long, without links, of no known language
    assert mainhtml.extract(pages(spark).limit(0)).count() == 0


def test_html_contracts():
    """Named anchors are no links; other languages, class names with further words, formulas and fieldsets stay."""
    assert mainhtml.main_text(f"<body><a name=top><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></body>") == f"Head\n\n{LONG}\n\n{LONG}"
    russian = "Это длинный абзац обычного текста на русском языке, в котором нет ни одной ссылки и много слов подряд."
    assert mainhtml.main_text(f"<div><p>{russian}</p><p>{russian}</p><ul><li><a href=x>Меню</a></li></ul></div>") == f"{russian}\n\n{russian}"
    kept = [f"<p class='{c}'>{c} {LONG}</p>" for c in ("share-price", "social-policy", "legal", "has-sidebar")]
    assert mainhtml.main_text(f"<main>{''.join(kept)}</main>").count(LONG) == 4
    assert mainhtml.main_text(f"<main><p>{LONG} <math><mi>x</mi></math></p><fieldset><p>{LONG}</p></fieldset></main>") == f"{LONG} x\n\n{LONG}"
    # In an article a short block takes the label of its nearest decided neighbour.
    page = f"<article><p>{LONG}</p><p>short</p><p>{LONG}</p><h2>More</h2><ul><li><a href=a>{LONG}</a></li><li><a href=b>{LONG}</a></li></ul><p>tail</p></article>"
    # Its lists of links are left out, and are no neighbours.
    assert mainhtml.main_text(page) == f"{LONG}\n\nshort\n\n{LONG}\n\nMore\n\ntail"
    assert mainhtml.main_text(f"<article><p>{LONG}</p><ul><li><a href=x>Link</a></ul><p>Zahl 12345.</p></article>") == f"{LONG}\n\nZahl 12345."
    # Comments by any name of theirs; short pages whole.
    for name in ("user-comments-list", "comments", "post_comment", "fb-comments x"):
        assert mainhtml.main_text(f"<div><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></div>") == LONG
    assert mainhtml.main_text(f"<section class='has-comments'><p>{LONG}</p></section>") == LONG
    assert mainhtml.main_text("<div><p>Hallo kurz.</p></div>") == "Hallo kurz."
    assert mainhtml.main_text("<ul><li><a href=a>Menu of it</a></ul><div><p>Hallo kurz.<p>Und mehr.</div>") == "Hallo kurz.\n\nUnd mehr."


def generated(rng):
    """A page of parts that are known to be furniture or article, and its main text."""
    common = "the of and to in a is it that for der die und le la de que el en un".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdeüéñ") for _ in range(rng.randrange(3, 9))) for _ in range(n)).capitalize() + "."
    menu = lambda: f"<nav><ul>{''.join(f'<li><a href=/{i}>{prose(2)}</a></li>' for i in range(rng.randrange(2, 9)))}</ul></nav>"
    box = lambda: f"<{(tag := rng.choice(('div', 'section')))} class=\"{rng.choice(('ad', 'sidebar', 'cookie-notice', 'user-comments-list', 'related', 'social-share', 'newsletter signup'))}\"><p>{prose(rng.randrange(3, 60))}</p></{tag}>"
    aside, foot, form = (lambda: f"<aside><p>{prose(30)}</p></aside>"), (lambda: f"<footer>{prose(20)}</footer>"), (lambda: f"<form><p>{prose(25)}</p><input></form>")
    blocks = [rng.choice(("h2", "p", "p", "p")) for _ in range(rng.randrange(1, 9))]
    texts = [prose(rng.randrange(2, 7)) if b == "h2" or rng.random() < 0.2 else prose(rng.randrange(25, 80)) for b in blocks]
    inner = "".join(f"<{b}>{t}" + (f"</{b}>" if b != "p" or rng.random() < 0.6 else "") + (rng.choice((box, form))() if rng.random() < 0.15 else "") for b, t in zip(blocks, texts))
    around = lambda: "".join(rng.choice((menu, box, aside, form, lambda: "<script>x<p>y</script><style>p{}</style><!-- c -->"))() for _ in range(rng.randrange(0, 4)))
    wrap = rng.choice(("article", "main"))
    return f"<html><head><title>T</title></head><body>{around()}<div class=wrapper><{wrap}>{inner}</{wrap}></div>{around()}{foot()}</body></html>", "\n\n".join(texts)


def test_generated_pages():
    """Pages made of known parts: exactly their articles."""
    import random

    rng = random.Random(12)
    pages_of = [generated(rng) for _ in range(400)]
    for html, want in pages_of:
        assert mainhtml.main_text(html) == want


def test_open_elements_take_linear_time():
    import time

    for piece in ("<a href=x>", "<b>", "<p><b>", "<li><a>", "<div>", "<span><p></p>", "<a><b>", "</b>", "<td>", "<nav><p>"):
        start = time.perf_counter()
        mainhtml.main_text(piece * 100_000 + LONG)
        mainhtml.main_text("<span>" * 100_000 + piece * 50_000 + LONG)
        assert time.perf_counter() - start < 20, piece


def test_large_ids(spark, tmp_path):
    """Ids above 2 ** 53 stay whole beside nulls."""
    big, html = 1 << 60, "<p>" + LONG * 20 + "</p>"
    p = spark.createDataFrame([(big + 1, "u", html), (big + 3, "u", html), (None, "u", "x"), (big + 5, None, None)], "page_id bigint, url string, html string").coalesce(1)
    assert {r.page_id for r in mainhtml.extract(p).collect()} == {big + 1, big + 3, big + 5, None}
    folder = f"file://{tmp_path}/w"
    warc.write(warc.plan(p), folder, b"").collect()
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()}
    assert got == {big + 1: ("revisit", big + 3), big + 3: ("response", None), None: ("response", None), big + 5: ("response", None)}
