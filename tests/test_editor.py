"""Checks and scores of editors: nulls, blanks and bounds."""

from pyspark.sql import functions as F

from gradus.operators import editor, reconstruction


def test_missing(spark):
    rows = [
        (None, None, None, None, None, None, ["text", "subject", "exam"]),
        ("long enough", "s", "e", "mcq", None, None, ["options", "key"]),
        (" ab  ", " ", "e", "mcq", ["a", None, " "], 0, ["text", "subject", "options"]),
        ("long enough", "s", "e", "mcq_multiple", ["a", "b"], None, []),
        ("long enough", "s", "e", "numerical", [], None, []),
    ]
    d = spark.createDataFrame(rows, "text string, subject string, exam string, kind string, options array<string>, correct int, want array<string>")
    got = d.select(editor.missing(*(F.col(c) for c in ("text", "subject", "exam", "kind", "options", "correct"))).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_scores_stay_in_bounds(spark):
    rows = [("x" * 20, "mcq", ["a"] * 4, 0, 1.0), ("x" * 20, "mcq", ["a"] * 3, 1, 0.75), (None, None, None, None, 0.8), ("short", "mcq", None, 50, 0.1), ("short", "text", [], 2, 0.5)]
    d = spark.createDataFrame(rows, "text string, kind string, options array<string>, warnings int, want double")
    got = d.select(editor.editor_confidence(F.col("text"), F.col("kind"), F.col("options"), F.col("warnings")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_fingerprints_of_nothing(spark):
    d = spark.createDataFrame([(None, None), ("", " \n"), (None, "text"), ("<b>x</b>", None), (None, "tesseract"), ("a pdf", "x"), ("x [FIGURE_", "[FIGURE_1]")], "h string, p string")
    f = reconstruction.fingerprint(F.col("h"), F.col("p"))
    got = [(r.source_type, r.images, r.scanned_content) for r in d.select(*(c.alias(n) for n, c in f.items())).collect()]
    assert got == [("unknown", False, False), ("unknown", False, False), ("plain_text", False, False), ("browser_html", False, False), ("ocr_output", False, True), ("pdf_extract", False, False), ("unknown", True, True)]
