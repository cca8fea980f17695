"""Text expressions of the question bank."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intake import EASY, HARD


# Characters of words, one by one: Java looks a class of single characters up in a table, but asks
# for each range in turn.
_WORD = f"{ascii_letters}{digits}_"


def normalised(c: Column) -> Column:
    """Key text: lower case, one space for white space, only word characters and $+-*/=().,"""
    c = F.regexp_replace(F.lower(c), r"[ \t\n\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(c, rf"[^{_WORD} $+\-*/=().,]", ""))


def duplicate_key(c: Column) -> Column:
    """SHA-256 of the key text; null where nothing is left."""
    # Bound in an array of one: else the key text is made once for the test and once for the hash.
    return F.get(F.transform(F.array(normalised(c)), lambda n: F.when(n != "", F.sha2(n, 256))), 0)


def tokens(c: Column) -> Column:
    """Words of over two characters of the key text, without punctuation."""
    w = F.filter(F.split(normalised(c), " "), lambda x: F.length(x) > 2)
    return F.filter(F.transform(w, lambda x: F.regexp_replace(x, f"[^{_WORD}]", "")), lambda x: x != "")


# Words without meaning for similarity.
STOP = ("the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "for", "to", "and", "or", "with", "what", "which", "find", "calculate", "determine", "following", "question", "answer")


# How formulas are marked, and what tells LaTeX.
LATEX = (r"\$\$([\s\S]+?)\$\$", r"\\\[([\s\S]+?)\\\]", r"\$([^$\n]+?)\$", r"\\\(([^)]+?)\\\)")
LATEX_SIGNS = r"\$|\\(?:frac|sqrt|int|sum|begin\{|alpha|beta|pi)|[_^][{\w]"


def without_delimiters(c: Column) -> Column:
    """LaTeX in dollars, brackets or parentheses without these marks."""
    for pattern in LATEX:
        c = F.regexp_replace(c, pattern, "$1")
    return c


def has_latex(c: Column) -> Column:
    return c.rlike(LATEX_SIGNS)


def primary_latex(c: Column) -> Column:
    """The first formula, displayed ones before those in a line; null if there is none."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in LATEX))


def stripped_latex(c: Column) -> Column:
    return F.trim(without_delimiters(c))


def content_tokens(c: Column) -> Column:
    """As `tokens`, without LaTeX delimiters and stop words; null texts have none."""
    words = F.split(without_delimiters(normalised(F.coalesce(c, F.lit("")))), " ")
    kept = F.filter(words, lambda x: (F.length(x) > 2) & ~x.isin(*STOP))
    return F.filter(F.transform(kept, lambda x: F.regexp_replace(x, f"[^{_WORD}]", "")), lambda x: x != "")


def equation_key(text: Column, latex: Column | None = None) -> Column:
    """Normal form of a formula: the given one, else the first in the text, else the text."""
    given = [F.nullif(latex, F.lit(""))] if latex is not None else []
    c = without_delimiters(F.coalesce(*given, primary_latex(text), text, F.lit("")))
    # What a construct is written as.
    for pattern, to in ((r"\\frac\s*\{([^}]+)\}\s*\{([^}]+)\}", "$1/$2"), (r"\\sqrt\s*\{([^}]+)\}", "sqrt($1)"), (r"\\int", "integral"), (r"\\sum", "sum"), (r"[_^]\{([^}]+)\}", "$1"), (r"[_^](\w)", "$1"), (r"\s+", "")):
        c = F.regexp_replace(c, pattern, to)
    return normalised(c)


def equation_likeness(a: Column, b: Column, latex: Column) -> Column:
    """Of two keys: 1 if equal, 0.85 if one of over 8 characters is inside the other, else 0; and
    0 where no text has LaTeX."""
    inside = (F.contains(a, b) & (F.length(b) > 8)) | (F.contains(b, a) & (F.length(a) > 8))
    return F.when(~latex | (a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, 0.85).otherwise(0.0)


def option_index(c: Column) -> Column:
    """0 for A, 1 for B and so on; null for all but single letters A to F."""
    return F.when(F.upper(c).rlike("^[A-F]$"), F.ascii(F.upper(c)) - 65)


def similarity(a: Column, b: Column) -> Column:
    """(longest - edit distance) / longest of lower-cased texts; 1 for two empty ones."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise((n - F.levenshtein(F.lower(a), F.lower(b))) / n)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole rounded half up; 0 where there is nothing."""
    scale = 10**digits
    return F.when(whole == 0, 0.0).otherwise(F.floor(part * 100.0 * scale / whole + 0.5) / scale)


def difficulty(text: Column, marks: Column) -> Column:
    """By a word that says so, else by marks and length."""
    n = F.length(text)
    said = F.when(text.rlike(f"(?i){EASY}"), "easy").when(text.rlike(f"(?i){HARD}"), "hard")
    return F.coalesce(said, F.when((marks >= 8) | (n > 450), "hard").when((marks <= 2) | (n < 120), "easy").otherwise("medium"))
