"""Text expressions on small cases."""

from pyspark.sql import functions as F

from gradus.functions import intake as I
from gradus.functions import text as T
from gradus.operators.intake import option_runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_leave_out_stop_words_and_delimiters(spark):
    assert one(spark, T.content_tokens(F.lit("Find the $speed$ of  the car, which is FAST"))) == ["speed", "car", "fast"]
    assert one(spark, T.content_tokens(F.lit(None).cast("string"))) == []


def test_equation_key(spark):
    assert one(spark, T.equation_key(F.lit(r"Take $$\frac{a}{b} + \sqrt{x}$$ now"))) == "a/b+sqrt(x)"
    assert one(spark, T.equation_key(F.lit(r"with $x^{2}_1$ inside"))) == "x21"
    assert one(spark, T.equation_key(F.lit("text"), F.lit(r"\int f"))) == "integralf"
    assert one(spark, T.equation_key(F.lit(None).cast("string"))) == ""


def test_equation_likeness(spark):
    like = lambda a, b: one(spark, T.equation_likeness(F.lit(a), F.lit(b), F.lit(True)))
    assert [like("a+b", "a+b"), like("a+b", "a+b=c"), like("a/b+sqrt(x)", "y=a/b+sqrt(x)"), like("", "")] == [1.0, 0.0, 0.85, 0.0]
    assert one(spark, T.equation_likeness(F.lit("a"), F.lit("a"), F.lit(False))) == 0.0


def test_class_number(spark):
    number = lambda s: one(spark, I.class_number(F.lit(s)))
    assert [number("Class - 11 physics"), number("std. 9"), number("Grade 7"), number("for XII"), number("none"), number("class 99, std 8")] == [11, 9, 7, 12, None, 8]


def test_fractions_and_runs(spark):
    assert one(spark, I.fractions(F.lit(r"1/2 and 3 / 4, $5/6 \7/8"))).startswith(r"$\frac{1}{2}$ and $\frac{3}{4}$")
    labels = F.array(*(F.lit(x) for x in "badbcd"))
    assert one(spark, I.longest_run(labels)) == [1, 3, 4, 5]
    assert one(spark, I.longest_run(F.array().cast("array<string>"))) == []


def test_references(spark):
    c = F.lit("&lt;a&gt; &#233;&#x1F600; &nope; &#xD800; &amp;amp;")
    assert one(spark, I.html_unescaped(c)) == "<a> é😀 &nope; &#xD800; &amp;"


def test_option_index(spark):
    assert [one(spark, T.option_index(F.lit(s))) for s in ("a", "D", "g", "")] == [0, 3, None, None]


def test_similarity(spark):
    assert one(spark, T.similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, T.similarity(F.lit("Kitten"), F.lit("sitting"))) == (7 - 3) / 7


def test_options_are_read_once(spark):
    """Marks and texts between them are found once a question, for the condition and both results."""
    part = spark.createDataFrame([(i, 1, "t") for i in range(20)], "p_partkey long, p_size int, p_type string")
    plan = option_runs(lambda name: part)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(I.OPTION_MARK) == 2
    many = F.concat(*(F.lit(f"({'abcdef'[i % 6]}) text {i} ") for i in range(60)))
    assert one(spark, F.transform(I.inline_options(many), lambda o: o["label"])) == list("abcdef")
