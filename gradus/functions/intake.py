"""Expressions that read question papers: options, sections, types, classes, exams, escapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and names that decide what a line or question is.
OPTION_LINE = r"^\s*(?:\(?\s*([a-fA-F])\s*\)?\s*[).:\-–—]\s*|([a-fA-F])\s*[).:\-–—]\s+)(.+)$"
OPTION_MARK = r"(?<![A-Za-z0-9])(?:\(\s*[a-fA-F]\s*\)|\b[a-fA-F]\s*[).])"
NUMBER = r"(?i)^(?:(?:Q(?:uestion)?\s*)?(\d{1,3})[).:\-\s]+|\((\d{1,3})\)\s+)"
TAGGED_NUMBER = r"(?i)^(?:Q(?:uestion)?\.?\s*)?(\d{1,3})\s*[.):]\s*"
LISTED_NUMBER = r"(?i)^(?:Q(?:uestion)?\s*)?\d{1,3}[).:\-\s]"
SECTION = r"(?i)^(?:SECTION|PART)\s*[-:]?\s*([A-Z0-9]+)(?:\s*[-:]\s*(.+))?$"
SECTIONS = (
    (r"section\s*a", "Section A", "mcq"),
    (r"section\s*b", "Section B", "numerical"),
    (r"single\s*correct", "Single Correct MCQ", "mcq"),
    (r"multiple\s*correct", "Multiple Correct MCQ", "mcq_multiple"),
    (r"numerical\s*value|integer\s*type", "Numerical/Integer", "numerical"),
    (r"match\s*the\s*following", "Match the Following", "match"),
    (r"comprehension|passage\s*based", "Comprehension", "comprehension"),
)
SUBJECT_LINE = r"(?i)^mathematics|^physics|^chemistry"
COMPREHENSION = r"comprehension|passage\s*based|read\s+the\s+following\s+passage|based\s+on\s+the\s+above\s+passage"
MATCHING = r"match\s+(?:the\s+)?following|list-?\s*i\b|list-?\s*ii\b|column\s+i\b"
SEVERAL = r"one\s+or\s+more\s+correct|multiple\s+correct|more\s+than\s+one\s+(?:of\s+the\s+)?(?:options?|choices?)|select\s+all\s+that\s+apply"
INTEGER = r"integer\s+(?:value|answer|type)|answer\s+in\s+integer|integer\s+between"
NUMERICAL = r"numerical\s+(?:value|answer|type)|numeric\s+answer|decimal\s+places|round\s+off"
UNIT = r"\b\d+(\.\d+)?\s*(cm|m|kg|g|mol|j|n|v|a|w|hz|s)\b"
STATEMENT = r"(?i)^\s*(?:\(?\s*(?:i+|[0-9]+|[a-z])\s*\)?\s*[.:\-–—]\s+|(?:\bStatement\s+[0-9]+)\s*[.:\-–—]\s+)(.+)$"
CLASS_NUMBERS = (r"\bclass\s*[-:]?\s*(\d{1,2})\b", r"\bstd\.?\s*(\d{1,2})\b", r"\bgrade\s*(\d{1,2})\b")
CLASS_ROMAN = r"\b(xii|xi|x|ix|viii|vii|vi)\b"
ROMAN = {"vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
EXAMS = ((r"\b(jee\s*main|jee\s*advanced|iit\s*jee)\b", "JEE"), (r"\b(neet|aipmt)\b", "NEET"), (r"\b(cbse|ncert)\b", "CBSE"), (r"\b(board|final\s*exam)\b", "BOARD"))
EASY = r"\b(easy|basic|simple|introductory)\b"
HARD = r"\b(hard|difficult|advanced|challenging|complex)\b"
FRACTION = r"(?<![\d$\\])(\d+)\s*/\s*(\d+)(?!\d)"
ENTITIES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

_FORMULA = r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$"
_PLAIN, _SHIELDED = "().[]", ""


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def _places(c: Column) -> Column:
    """0 to n - 1 for an array of n; empty for an empty one."""
    return F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))


def once(value: Column, use) -> Column:
    """`use` of a value that is computed once: inside a lambda, an expression is made anew for
    each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shielded(c: Column) -> Column:
    """Text whose formulas in dollars hold no brackets or stops, so that no marker is seen there."""
    found = F.struct(F.split(c, _FORMULA, -1).alias("parts"), F.regexp_extract_all(c, F.lit(f"({_FORMULA})"), F.lit(1)).alias("formulas"))
    return once(found, lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(F.translate(F.get(x["formulas"], i), _PLAIN, _SHIELDED), F.lit("")))), ""))


def is_option(line: Column) -> Column:
    return line.rlike(OPTION_LINE)


def option_label(line: Column) -> Column:
    return F.lower(F.concat(F.regexp_extract(line, OPTION_LINE, 1), F.regexp_extract(line, OPTION_LINE, 2)))


def option_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, OPTION_LINE, 3))


def _labels(marks: Column) -> Column:
    return F.transform(marks, lambda m: F.lower(F.regexp_extract(m, "[a-fA-F]", 0)))


def marker_labels(c: Column) -> Column:
    """Labels of all option markers of a text, formulas left out."""
    return _labels(F.regexp_extract_all(shielded(c), F.lit(f"({OPTION_MARK})"), F.lit(1)))


def longest_run(labels: Column) -> Column:
    """Places of the longest run of labels in order that begins anywhere; the first of equal ones."""

    def longest(codes: Column) -> Column:
        after = lambda i: F.filter(_places(codes), lambda j: j > i)
        follows = lambda acc, j: F.get(codes, j) == F.get(codes, F.element_at(acc, -1)) + 1
        run = lambda i: F.aggregate(after(i), F.array(i), lambda acc, j: F.when(follows(acc, j), F.concat(acc, F.array(j))).otherwise(acc))
        return F.aggregate(F.transform(_places(codes), run), F.array().cast("array<int>"), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))

    return once(F.transform(labels, lambda x: F.ascii(x)), longest)


def fractions(c: Column) -> Column:
    """Plain fractions as LaTeX."""
    return F.regexp_replace(c, FRACTION, r"\$\\frac{$1}{$2}\$")


def inline_options(c: Column) -> Column:
    """(label, text) of the options in a text: from each marker of the longest run to the next;
    empty without two."""
    def options(bound: Column) -> Column:
        marks, parts, run = bound["marks"], bound["parts"], bound["run"]
        upto = lambda k: F.coalesce(F.get(run, k + 1), F.size(marks))
        inside = lambda k: F.filter(_places(marks), lambda j: (j >= F.get(run, k)) & (j < upto(k)))
        said = lambda k: F.array_join(F.transform(inside(k), lambda j: F.concat(F.when(j == F.get(run, k), "").otherwise(F.get(marks, j)), F.get(parts, j + 1))), "")
        clean = lambda x: F.translate(fractions(F.regexp_replace(F.regexp_replace(x, r"^[\s).:\-–—]+", ""), r"\s+$", "")), _SHIELDED, _PLAIN)
        every = F.transform(_places(run), lambda k: F.struct(F.get(_labels(marks), F.get(run, k)).alias("label"), clean(said(k)).alias("text")))
        return F.when(F.size(run) >= 2, F.filter(every, lambda o: o["text"] != "")).otherwise(F.array().cast("array<struct<label:string,text:string>>"))

    # Bound once in an array of one, else each use repeats the patterns.
    bound = F.transform(F.array(c), shielded)
    bound = F.transform(bound, lambda s: F.struct(F.regexp_extract_all(s, F.lit(f"({OPTION_MARK})"), F.lit(1)).alias("marks"), F.split(s, OPTION_MARK, -1).alias("parts")))
    bound = F.transform(bound, lambda b: F.struct(b["marks"].alias("marks"), b["parts"].alias("parts"), longest_run(_labels(b["marks"])).alias("run")))
    return F.get(F.transform(bound, options), 0)


def section_name(line: Column) -> Column:
    """Name of the section that a line opens; null for other lines."""
    hints = reduce(lambda rest, x: F.when(_has(line, x[0]), x[1]).otherwise(rest), reversed(SECTIONS), F.lit(None).cast("string"))
    subject = F.when(line.rlike(SUBJECT_LINE) & (F.length(line) < 40), line)
    return F.when(line.rlike(SECTION), F.concat(F.lit("Section "), F.regexp_extract(line, SECTION, 1))).otherwise(F.coalesce(hints, subject))


def section_part(line: Column) -> Column:
    hints = reduce(lambda rest, x: F.when(_has(line, x[0]), x[2]).otherwise(rest), reversed(SECTIONS), F.lit(None).cast("string"))
    return F.when(~line.rlike(SECTION), hints)


def subtype(c: Column) -> Column:
    """The first rule that holds for a question."""
    n = F.size(F.array_distinct(marker_labels(c)))
    several = F.when(_has(c, SEVERAL) & (n >= 2), "mcq_multiple").when(n >= 2, "mcq_single")
    number = F.when(_has(c, INTEGER) | c.rlike(r"^\s*\d+\s*$"), "integer").when(_has(c, NUMERICAL) | _has(c, UNIT), "numerical")
    single = F.when(c.rlike(r"\([a-fA-F]\)") & (n == 1), "mcq_incomplete")
    passage = F.when(_has(c, COMPREHENSION), "comprehension").when(_has(c, MATCHING), "match_following")
    return F.coalesce(passage, several, number, single, F.lit("descriptive"))


def type_of(subtype: Column) -> Column:
    return F.when(subtype.startswith("mcq"), "mcq").when(subtype.isin("integer", "numerical"), "numerical").otherwise("descriptive")


def semantic_kind(c: Column) -> Column:
    """One of twelve kinds of question, by the first rule that holds."""
    mark = r"(?i)(?:^|[^a-zA-Z0-9_$])((?:OPTION_[A-F]|[\(\[]\s*[A-F]\s*[\)\]]|\b[A-F]\s*[\).:\-–—]))(?=\s|$)"
    found = F.regexp_extract_all(c, F.lit(mark), F.lit(1))
    n = F.size(F.array_distinct(F.transform(found, lambda m: F.upper(F.regexp_extract(F.regexp_replace(m, "(?i)OPTION_", ""), "[A-Fa-f]", 0)))))
    layered = _has(c, r"\b(statement|i|ii|iii|iv|a|b|c)\b") & _has(c, r"only\s+[a-f]\s+and\s+[a-f]|[a-f]\s*,\s*[a-f]\s*only")
    # What tells a kind.
    rules = (
        (_has(c, r"comprehension|passage\s*based|read\s+the\s+following\s+passage"), "COMPREHENSION"),
        (_has(c, r"case\s*study|read\s+the\s+following\s+case"), "CASE_STUDY"),
        (_has(c, "assertion") & _has(c, "reason"), "ASSERTION_REASON"),
        (_has(c, r"match\s+(?:the\s+)?following|column\s+i\b|list-?\s*i\b"), "MATCH_COLUMNS"),
        (_has(c, r"matrix\s*match"), "MATRIX_MATCH"),
        (_has(c, r"true\s+or\s+false|true\s*/\s*false"), "TRUE_FALSE"),
        ((n >= 2) & layered, "NESTED_OPTION_MCQ"),
        ((n >= 2) & _has(c, r"one\s+or\s+more\s+correct|multiple\s+correct|more\s+than\s+one\s+correct|select\s+all\s+that\s+apply"), "MCQ_MULTI"),
        (n >= 2, "MCQ_SINGLE"),
        (_has(c, "integer"), "INTEGER"),
        (_has(c, "numeric"), "NUMERICAL"),
    )
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit("DESCRIPTIVE"))


def is_statement(line: Column) -> Column:
    return line.rlike(STATEMENT)


def statement(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, STATEMENT, 1))


def _class(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(6, 12), n)


def _roman(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair)), F.lower(c))


def class_number(c: Column) -> Column:
    """School class from 6 to 12 named in a text, in digits before Roman numerals; null if none is."""
    return F.coalesce(*(_class(F.regexp_extract(c, f"(?i){p}", 1)) for p in CLASS_NUMBERS), _roman(F.regexp_extract(c, f"(?i){CLASS_ROMAN}", 1)))


def classes(c: Column) -> Column:
    """All classes that a text names."""
    found = [F.transform(F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(1)), _class) for p in CLASS_NUMBERS]
    roman = F.transform(F.regexp_extract_all(c, F.lit(f"(?i){CLASS_ROMAN}"), F.lit(1)), _roman)
    return F.array_distinct(F.array_compact(F.concat(*found, roman)))


def exam(c: Column) -> Column:
    return reduce(lambda rest, x: F.when(_has(c, x[0]), x[1]).otherwise(rest), reversed(EXAMS), F.lit(None).cast("string"))


def html_escaped(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def html_unescaped(c: Column) -> Column:
    """Named, decimal and hexadecimal references as characters; unknown ones stay."""
    pattern = r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z]+);"
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def char(ref: Column) -> Column:
        body = F.substring(ref, 2, 9)
        code = F.when(ref.rlike("^&#[xX]"), F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)", 1)).when(ref.startswith("&#"), F.conv(F.regexp_extract(body, "^#([0-9]+)", 1), 10, 16))
        good = F.conv(code, 16, 10).cast("int").between(1, 0x10FFFF) & ~F.conv(code, 16, 10).cast("int").between(0xD800, 0xDFFF)
        return F.coalesce(F.when(good, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")), F.try_element_at(names, F.regexp_extract(ref, "^&([A-Za-z]+);", 1)), ref)

    found = F.struct(F.split(c, pattern, -1).alias("parts"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("refs"))
    return once(found, lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(char(F.get(x["refs"], i)), F.lit("")))), ""))


def listed(c: Column) -> Column:
    """A comma-separated text as a list: trimmed, blanks left out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def regex_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"[.*+?^${}()|\[\]\\]", r"\\$0")
