"""Repairs of formulas against a walk over the characters, and edge cases."""

import random

from pyspark.sql import functions as F

from gradus.functions import cleaning, latex
from gradus.operators import formulas


def walked(s):
    """Braces by the rule, character by character."""
    if s.count("{") >= s.count("}"):
        return s + "}" * (s.count("{") - s.count("}"))
    depth, out = 0, ""
    for c in s:
        if c != "}" or depth:
            out += c
            depth += (c == "{") - (c == "}")
    return out + "}" * depth


def test_braces(spark):
    rng = random.Random(3)
    texts = ["", "{", "}", "}{", "}}{"] + ["".join(rng.choice("{}}ab ") for _ in range(rng.randrange(0, 15))) for _ in range(300)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in d.select(latex.balanced_braces(F.col("t")).alias("s")).collect()] == [walked(t) for t in texts]


def test_regions(spark):
    cases = {
        "  $x$ ": "$x$", "$$ 1/2 $$": r"$$\frac{1}{2}$$", r"\[ a <= b \]": r"$$a \le b$$", r"\( α \)": r"$\alpha$", "and/or": "and/or", "x-y=z": "$x-y=z$",
        "": "", "   ": "", r"$\foo{x}$": "$foo{x}$", r"$\fracx \frac{1}{2}$": r"$fracx \frac{1}{2}$", "$$": "$$$$", "$": "$$", "plain words": "$plain words$", "3 * 4 ≠ 5": r"$3 \times 4 \ne 5$", r"\frac{1/2": r"$\frac{\frac{1}{2}}$",
    }
    d = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.s for r in d.select("t", latex.region(F.col("t")).alias("s")).collect()}
    assert got.pop(None) is None
    assert got == cases


def test_text(spark):
    d = spark.createDataFrame([("Normal 0 false false false EN-US  x é​  y\n \n\n\n z—", "Correct: (b) or answer - C"), (None, None), ("", "no letter, answers: 7")], "a string, b string")
    letter, place = latex.answer_in(F.col("b"))
    got = [tuple(r) for r in d.select(latex.safe_text(F.col("a")), letter, place).collect()]
    assert got == [("x y\n\n z", "B", 1), (None, None, None), ("", None, None)]


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "organic chemistry of it"), (2, "biochemistry"), (3, ""), (4, None), (5, "pat"), (6, "xyzw")], "k int, t string")
    entries = spark.createDataFrame([(3, "chemistry"), (1, "organic chemistry"), (2, "of"), (9, "pat"), (8, ""), (7, "z")], "i int, name string")
    assert {r.k: r.entry for r in formulas.first_phrase(texts, entries, "k", "t").collect()} == {1: 1, 2: 3, 3: None, 4: None, 5: 9, 6: 7}


def test_shorthand(spark):
    cases = {
        "If x2 + y2 = z2, find the value of ½ of sqrtx and ¾ of sqrt(y) when frac14 of z is given.": r"If x^2 + y^2 = z^2, find the value of \frac{1}{2} of \sqrt{x} and \frac{3}{4} of \sqrt{y} when \frac{1}{4} of z is given.",
        "Review Question 2: In Chapter 3, page 4, version2 of option 3 did not match version4.": None,
        "see x2 at https://a.b/c=d and <i>": None, r"x2 in C:\dir-a": None, "x2 " + "w" * 50 + " =": None, "x2 " + "w" * 40 + " =": "x^2 " + "w" * 40 + " =",
        "e2 = x1 = m5": None, "": None,
    }
    d = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.s for r in d.select("t", latex.with_powers(cleaning.prepared_math(F.col("t"))).alias("s")).collect()}
    assert got.pop(None) is None
    assert got == {k: k if v is None else v for k, v in cases.items()}
