"""As-of joins, images of options, metadata, ranked sources, dumps and reports."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gradus.operators import evidence as E
from gradus.sources import dumps


def test_as_of_against_all(spark):
    """Ties, equal places, marks before the first row, null keys and repeated rows."""
    rng = random.Random(2)
    key = lambda: rng.choice((1, 2, None))
    rows = [(key(), rng.randrange(30), i % 40) for i in range(80)] * 2
    marks = [(key(), rng.randrange(30), rng.choice((1, 2, 3))) for _ in range(30)] + [(1, 5, 9), (1, 5, 8)]
    r = spark.createDataFrame(rows, "k int, at int, v int").repartition(3)
    m = spark.createDataFrame(marks, "k int, at int, mark int").repartition(3)
    got = sorted((*x,) for x in E.as_of(r, m, ["k"], ["at"], ["mark"]).fillna(-1).select("k", "at", "v", "mark").collect())
    want = []
    for k, at, v in rows:
        before = [(a, x) for j, a, x in marks if j == k and a <= at]
        want.append((-1 if k is None else k, at, v, max(before)[1] if before else -1))
    assert got == sorted(want)
    assert E.as_of(r.limit(0), m, ["k"], ["at"], ["mark"]).count() == 0
    assert E.as_of(r, m.limit(0), ["k"], ["at"], ["mark"]).where("mark is not null").count() == 0


def test_images_of_options(spark):
    html = "<img src=stem.png><p>(A) one <img src='a1.png'></p><p><img src='a2.png'>B) <img src=b.png> (C) two</p><img><img src=c.png>"
    d = spark.createDataFrame([(1, html), (2, None), (3, "<img src=x>"), (4, "(A) only text")], "id int, html string")
    got = sorted(tuple(r) for r in E.option_images(d, "html", "id").collect())
    assert got == [(1, "A", 1, "a1.png"), (1, "A", 2, "a2.png"), (1, "B", 1, "b.png"), (1, "C", 1, "c.png")]


def test_document_metadata(spark):
    far = "x" * 4000 + " class 9"
    d = spark.createDataFrame([(1, "Class 9 and class XII paper, NEET"), (2, "class 8"), (3, None), (4, far)], "id int, text string")
    got = {r.id: (r["class"], r.mixed, r.class_confidence, r.exam, r.exam_confidence) for r in E.document_metadata(d, "text", "id").collect()}
    assert got[1][1:3] == (True, 0.4) and got[1][3:] == ("NEET", 0.75)
    assert got[2] == (8, False, 0.85, None, 0.2) and got[3] == got[4] == (11, False, 0.6, None, 0.2)


SOURCE = "struct<class:int,subject:string,exam:string,difficulty:string,confidence:double,tags:array<string>>"


def test_precedence(spark):
    """Each field from the first that has it: rules, matches, model, document."""
    def made(**f):
        return tuple(f.get(n) for n in ("class", "subject", "exam", "difficulty", "confidence", "tags"))

    full = lambda x: made(**{"class": x}, subject=f"s{x}", exam=f"e{x}", difficulty=f"d{x}", confidence=x / 10, tags=[f"t{x}", "t"])
    rows = [
        (1, (20, "doc"), full(6), full(7), full(8), "text"),
        (2, (20, "doc"), made(), full(7), full(8), "text"),
        (3, (20, "doc"), None, None, full(8), "text"),
        (4, (20, "doc"), None, None, None, "text"),
        (5, (None, None), made(confidence=0.9, subject="s"), None, None, "text"),
    ]
    d = spark.createDataFrame(rows, f"key int, document struct<class:int,exam:string>, rules {SOURCE}, semantic {SOURCE}, model {SOURCE}, difficulty string")
    got = {r[0]: tuple(r)[1:] for r in E.merged_evidence(d).collect()}
    assert got[1] == (6, "s6", "e6", "d6", "t6,t,t8", 70, "pending", "rules+semantic+model")
    assert got[2] == (7, "s7", "e7", "d8", "t8,t", 60, "pending", "rules+semantic+model")
    assert got[3] == (8, None, "doc", "d8", "t8,t", 55, "needs_review", "rules+semantic+model")
    assert got[4] == (20, None, "doc", "text", "", 30, "needs_review", "rules+semantic")
    assert got[5] == (None, "s", None, "text", "", 90, "needs_review", "rules+semantic")


@pytest.fixture
def source(spark):
    spark.dataSource.register(dumps.DumpFiles)


def test_dumps_round_trip(spark, source, tmp_path):
    at = str(tmp_path / "dumps")
    os.makedirs(at)
    rows = [(f"paste {i}", f"plain {i}\nline é", f"<p>{i}</p>\n<b>x</b>") for i in range(250)] + [("none", None, ""), ("odd", "a\n\n b", "<i>😀</i>")]
    d = spark.createDataFrame(rows, "name string, plain string, html string").repartition(7)
    d.write.format("dumps").mode("append").save(at)
    read = spark.read.format("dumps").option("files", 40).load(at)
    assert read.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, read.collect())) == sorted((n, p or "", h, None) for n, p, h in rows)
    assert not [n for n in os.listdir(at) if n.startswith(".")]
    d.limit(3).write.format("dumps").mode("overwrite").save(at)
    assert spark.read.format("dumps").load(at).count() == 3


def test_a_failed_write_leaves_nothing(spark, source, tmp_path):
    at = str(tmp_path / "dumps")
    os.makedirs(at)
    bad = F.when(F.col("id") == 77, F.lit("a/b")).otherwise(F.col("id").cast("string"))
    d = spark.range(100).repartition(4).select(bad.alias("name"), F.lit("p").alias("plain"), F.lit("h").alias("html"))
    with pytest.raises(Exception, match="not a file name"):
        d.write.format("dumps").mode("append").save(at)
    assert os.listdir(at) == []


def test_dumps_of_other_hands(spark, source, tmp_path):
    files = {"both": "x\r\n text/plain \r\nskipped\r\na\r\nb\r\ntext/html\r\n\r\n<p>\r\n", "lost": "text/plain\n\nonly", "blank": ""}
    for n, t in files.items():
        (tmp_path / f"{n}.txt").write_bytes(t.encode())
    (tmp_path / "other.csv").write_text("x")
    got = {r.name: (r.plain, r.html, r.error) for r in spark.read.format("dumps").load(str(tmp_path)).collect()}
    assert got == {"both": ("a\nb", "<p>", None), "lost": (None, None, "no text/html"), "blank": (None, None, "no text/plain and text/html")}


def test_report_is_read_again(spark, tmp_path):
    rows = [(10 * i, i if i % 2 else None, i / 10, i % 2 == 0, True, i % 3) for i in range(9)]
    e = dumps.numbered(spark.createDataFrame(rows, "o int, qnum int, similarity double, options_match boolean, class_match boolean, warnings int").repartition(3), "o")
    assert [r["index"] for r in e.orderBy("o").collect()] == list(range(9))
    at = str(tmp_path / "report")
    dumps.report(e).orderBy("place").coalesce(1).select("line").write.text(at)
    lines = [r.value for r in spark.read.text(at).collect()]
    assert lines[6] == "| **Total Detected Questions** | **9** |" and lines[7] == "| **Average Stem Match Similarity** | **40.00%** |"
    assert lines[16] == "| 0 | N/A | 0% | yes | yes | Success |" and len(lines) == 25
    assert dumps.report(e.limit(0)).count() == 16
