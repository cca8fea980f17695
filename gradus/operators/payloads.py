"""Answers of models and clients as JSON: recovery, defaults, values of two kinds, what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query


def json_value(raw: Column) -> Column:
    """JSON in a text as a variant: the whole text, else what is from its first brace to its last;
    null if neither is JSON."""
    inside = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.nullif(inside, F.lit(""))))


def _kind(v: Column) -> Column:
    """Kind of a variant: STRING, ARRAY, OBJECT, VOID for a null, and so on; null if it is missing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_field(v: Column, name: str, default: str | None = None, null: bool = False) -> tuple[Column, Column]:
    """A text of an object, its default if it is missing, and whether it is wrong: another kind, or
    a null where none may be."""
    part = _part(v, f"$.{name}")
    good = ("STRING", "VOID") if null else ("STRING",)
    value = F.when(_kind(part) == "STRING", F.try_variant_get(v, f"$.{name}", "string")).when(part.isNull(), F.lit(default))
    return value, part.isNotNull() & ~_kind(part).isin(*good)


def text_list(v: Column, name: str, single: bool = False) -> tuple[Column, Column]:
    """A list of texts of an object, empty if it is missing; with `single` a text alone is a list
    of one; and whether it is wrong."""
    part = _part(v, f"$.{name}")
    items = F.try_variant_get(v, f"$.{name}", "array<variant>")
    texts = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    is_list = _kind(part) == "ARRAY"
    bad = is_list & F.exists(items, lambda x: ~F.coalesce(_kind(x) == "STRING", F.lit(False)))
    alone = (_kind(part) == "STRING") if single else F.lit(False)
    value = F.when(part.isNull(), F.array().cast("array<string>")).when(alone, F.array(F.try_variant_get(v, f"$.{name}", "string"))).when(is_list & ~bad, texts)
    return value, part.isNotNull() & F.coalesce(~is_list & ~alone | bad, F.lit(True))


OPTION = "struct<text:string,latex:string,image:string>"


def option_list(v: Column) -> tuple[Column, Column]:
    """Options, each a text or an object with text, latex and image; and whether they are wrong."""
    part = _part(v, "$.options")
    items = F.try_variant_get(v, "$.options", "array<variant>")

    def option(x: Column) -> Column:
        own = {n: text_field(x, n, "" if n == "text" else None, null=n != "text") for n in ("text", "latex", "image")}
        of_object = F.struct(*(c.alias(n) for n, (c, _) in own.items()))
        none = F.lit(None).cast("string")
        of_text = F.struct(F.try_variant_get(x, "$", "string").alias("text"), none.alias("latex"), none.alias("image"))
        wrong = F.when(_kind(x) == "STRING", False).when(_kind(x) == "OBJECT", own["text"][1] | own["latex"][1] | own["image"][1]).otherwise(True)
        return F.struct(F.when(_kind(x) == "STRING", of_text).otherwise(of_object).alias("option"), F.coalesce(wrong, F.lit(True)).alias("wrong"))

    each = F.transform(items, option)
    is_list = _kind(part) == "ARRAY"
    bad = is_list & F.exists(each, lambda x: x["wrong"])
    value = F.when(part.isNull(), F.array().cast(f"array<{OPTION}>")).when(is_list & ~bad, F.transform(each, lambda x: x["option"]))
    return value, part.isNotNull() & F.coalesce(~is_list | bad, F.lit(True))


def questions(rows: DataFrame, raw: str, *keys: str) -> DataFrame:
    """Questions that a model gave as JSON: keys, question_type, stem, options, correct_answers,
    explanation, tags, errors.

    What is missing has its default; a value of the wrong kind is null and its name stands in
    `errors`; so does `json` for a text without JSON, and `object` for JSON of another kind, which
    have no values.  The variant is made once for each row.
    """
    v = rows.select(*keys, F.explode(F.array(F.struct(json_value(F.col(raw)).alias("v")))).alias("s")).select(*keys, "s.v")
    j = F.col("v")
    is_object = F.coalesce(_kind(j) == "OBJECT", F.lit(False))
    fields = {
        "question_type": ("questionType", text_field(j, "questionType", "DESCRIPTIVE")),
        "stem": ("stem", text_field(j, "stem", "")),
        "options": ("options", option_list(j)),
        "correct_answers": ("correctAnswers", text_list(j, "correctAnswers", single=True)),
        "explanation": ("explanation", text_field(j, "explanation", "")),
        "tags": ("tags", text_list(j, "tags")),
    }
    wrong = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, (_, bad) in fields.values())))
    errors = F.when(j.isNull(), F.array(F.lit("json"))).when(~is_object, F.array(F.lit("object"))).otherwise(wrong)
    return v.select(*keys, *(F.when(is_object, value).alias(n) for n, (_, (value, _)) in fields.items()), errors.alias("errors"))


@query("""WITH e AS (SELECT event_id, event_id % 9 AS k, json_extract_string(props, '$.k') AS v, user_id, event_type FROM events)
SELECT event_id, CASE WHEN k IN (6, 7) THEN NULL WHEN k = 1 THEN event_type ELSE 'DESCRIPTIVE' END AS question_type, CASE WHEN k IN (6, 7) THEN NULL WHEN k = 3 THEN NULL ELSE 'user ' || user_id END AS stem,
 CASE k WHEN 0 THEN 'a' || v || ';b,x^2' WHEN 1 THEN 'v' || v WHEN 2 THEN '' WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE '' END AS options,
 CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'A+B' WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE '' END AS correct, CASE k WHEN 3 THEN 'stem' WHEN 4 THEN 'options' WHEN 5 THEN 'correctAnswers,tags' WHEN 6 THEN 'json' WHEN 7 THEN 'object' ELSE '' END AS errors FROM e""")
def model_questions(t) -> DataFrame:
    """Questions from JSON with text around it, missing values, options of two kinds, wrong kinds and cut ends."""
    k, value = F.col("event_id") % 9, F.get_json_object("props", "$.k")
    stem = F.concat(F.lit('"stem":"user '), F.col("user_id").cast("string"), F.lit('"'))
    texts = [
        F.concat(F.lit("{"), stem, F.lit(',"options":["a'), value, F.lit('",{"text":"b","latex":"x^2","image":null}],"correctAnswers":"A"}')),
        F.concat(F.lit("Sure: {"), stem, F.lit(',"questionType":"'), "event_type", F.lit('","options":[{"text":"v'), value, F.lit('"}],"correctAnswers":["A","B"]} done')),
        F.concat(F.lit("```json\\n{"), stem, F.lit(',"options":[],"tags":["x"]}\\n```')),
        F.concat(F.lit('{"stem":'), value, F.lit("}")),
        F.concat(F.lit("{"), stem, F.lit(',"options":["a",7]}')),
        F.concat(F.lit("{"), stem, F.lit(',"correctAnswers":[1],"tags":"x"}')),
        F.concat(F.lit("{"), stem, F.lit(',"options":[')),
        F.concat(F.lit("["), value, F.lit(",2]")),
    ]
    raw = F.coalesce(*(F.when(k == i, c) for i, c in enumerate(texts)), F.concat(F.lit("{"), stem, F.lit("}")))
    q = questions(t("events").select("event_id", raw.alias("raw")), "raw", "event_id")
    options = F.array_join(F.transform("options", lambda o: F.concat_ws(",", o["text"], o["latex"])), ";")
    return q.select("event_id", "question_type", "stem", options.alias("options"), F.array_join("correct_answers", "+").alias("correct"), F.array_join("errors", ",").alias("errors"))
