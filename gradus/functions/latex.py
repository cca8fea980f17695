"""Repairs of formulas and of text around them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .intake import html_unescaped, once

# Signs and what they are in LaTeX, in this order; operators written with two signs;
# characters that stay in a question's text; what word processors leave in plain text.
SIGNS = {
    "∩": r" \cap ", "∪": r" \cup ", "⊂": r" \subset ", "⊆": r" \subseteq ", "√": r" \sqrt ", "π": r" \pi ", "∑": r" \sum ", "∫": r" \int ",
    "≤": r" \le ", "≥": r" \ge ", "≠": r" \ne ", "±": r" \pm ", "×": r" \times ", "÷": r" \div ", "−": " - ",
    "α": r" \alpha ", "β": r" \beta ", "γ": r" \gamma ", "δ": r" \delta ", "θ": r" \theta ", "λ": r" \lambda ", "μ": r" \mu ", "σ": r" \sigma ",
    "φ": r" \phi ", "ψ": r" \psi ", "omega": r" \omega ", "ω": r" \omega ",
}
OPERATORS = {"<=": r" \le ", ">=": r" \ge ", "!=": r" \neq ", "<>": r" \neq ", "*": r" \times ", "∈": r" \in ", "∉": r" \notin "}
SAFE = "a-zA-Z0-9\\s.,;:!?@#&%\"'~$()\\[\\]{}=+\\-*/^_∩∪⊂⊆√π∑∫≤≥≠−×÷|\\\\"
NOISE = (r"(?i)Normal\s+0\s+false\s+false\s+false\s+[A-Z\-]+", r"(?i)false\s+false\s+false\s+EN-US\s+JH\s+K[0-9]+", r"(?i)false\s+false\s+false\s+EN-US", r"(?i)\bNormal\s+0\b", "(?m)^\\s*[\u00a0\\f\\x0B]+\\s*$", r"(?i)\bMsoNormal\b")
MATHS = r"[=<>+*\\^_∩∪√≤≥≠−±×÷]|\b[PQR]\s*\(|\d"
ANSWER = r"(?i)(?:answer|ans|correct)\s*[:\-]?\s*\(?([a-fA-F])\)?"
# A letter with a number that may be a power, how far around it signs of mathematics
# are looked for, such signs, and what hides them.
POWER = re.compile(r"\b([x-za-dn-p])([2-9])\b", re.A)
AROUND = 50
LATEX_SIGN = re.compile(r"\$|\\\(|\\\[|\\frac|\\sqrt|\\cap|\\cup|\\pi|\\le|\\ge|\\ne|\\neq|\\pm|\\times|\\div")
HIDING = re.compile(r"https?://\S+|[a-zA-Z]:\\[a-zA-Z0-9\\._-]+|<[^>]+>")
OPERATOR = re.compile(r"[-+=*<>]")
#: Commands that stay commands.
COMMANDS = tuple("frac sqrt sum int prod lim sin cos tan log ln alpha beta gamma delta theta lambda mu sigma phi psi omega pi cap cup subset subseteq le ge ne neq in notin pm times div cdot infty left right begin end text vec hat bar overset underset mathbf rightarrow Rightarrow".split())


def balanced_braces(c: Column) -> Column:
    """As many closing braces as opening ones: missing ones at the end; of too many, those that
    close nothing go."""
    count = lambda x, b: F.length(x) - F.length(F.replace(x, F.lit(b), F.lit("")))

    def fixed(x: Column) -> Column:
        off = count(x, "{") - count(x, "}")
        step = lambda a, p: F.struct(
            F.concat(a["out"], F.when((p == "}") & (a["n"] == 0), "").otherwise(p)).alias("out"),
            F.when(p == "{", a["n"] + 1).when((p == "}") & (a["n"] > 0), a["n"] - 1).otherwise(a["n"]).alias("n"),
        )
        pieces = F.filter(F.split(F.regexp_replace(x, r"([{}])", "\x01$1\x01"), "\x01"), lambda p: p != "")
        walked = F.aggregate(pieces, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda a: F.concat(a["out"], F.repeat(F.lit("}"), a["n"])))
        return F.when(off == 0, x).when(off > 0, F.concat(x, F.repeat(F.lit("}"), off.cast("int")))).otherwise(walked)

    return once(c, fixed)


def known_commands(c: Column, commands: tuple[str, ...] = COMMANDS) -> Column:
    """LaTeX whose unknown commands lose their backslash."""
    return F.regexp_replace(c, rf"\\(?!(?:{'|'.join(commands)})(?![a-zA-Z]))([a-zA-Z]+)", "$1")


def syntax(c: Column) -> Column:
    """Operators as LaTeX, braces balanced, unknown commands as words."""
    return known_commands(balanced_braces(reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), OPERATORS.items(), c)))


def region(c: Column) -> Column:
    """A formula's text in dollars: two if it was displayed.  Signs and fractions are LaTeX, and
    white space is one space; two words with a sign between and no other mark of mathematics
    stay; blank text is empty."""

    def inside(t: Column) -> Column:
        kinds = (("$$", "$$", "$$", 2), ("$", "$", "$", 1), (r"\[", r"\]", "$$", 2), (r"\(", r"\)", "$", 2))
        of = [F.when(t.startswith(a) & t.endswith(b), F.struct(F.lit(d).alias("d"), F.substring(t, F.lit(n + 1), F.length(t) - 2 * n).alias("t"))) for a, b, d, n in kinds]
        word = ~t.rlike(MATHS) & t.rlike("^[a-zA-Z]+[-/][a-zA-Z]+$")
        return F.when(t == "", F.struct(F.lit("").alias("d"), t.alias("t"))).otherwise(F.coalesce(*of, F.when(word, F.struct(F.lit("").alias("d"), t.alias("t"))), F.struct(F.lit("$").alias("d"), t.alias("t"))))

    def written(x: Column) -> Column:
        t = syntax(reduce(lambda y, s: F.replace(y, F.lit(s[0]), F.lit(s[1])), SIGNS.items(), F.trim(x["t"])))
        t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?<![\d\\])(\d+)\s*/\s*(\d+)(?!\d)", r"\\frac{$1}{$2}"), r"\s+", " "))
        return F.when(x["d"] == "", x["t"]).otherwise(F.concat(x["d"], t, x["d"]))

    return once(inside(F.regexp_replace(c, r"^\s+|\s+$", "")), written)


def safe_text(c: Column) -> Column:
    """Text without what word processors leave, characters of no width, and any that a question
    does not need; blank runs are short."""
    c = reduce(lambda x, p: F.regexp_replace(x, p, " "), NOISE, c)
    c = F.regexp_replace(F.translate(c, "\u00a0", " "), "[\u200b-\u200d\ufeff]", "")
    c = F.regexp_replace(c, f"[^{SAFE}]", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def with_scripts(html: Column) -> Column:
    """Text of a word processor's HTML, with raised, lowered and bold text as LaTeX, and displayed
    formulas in two dollars."""
    c = F.regexp_replace(html, r'(?is)<p[^>]*class="[^"]*equation[^"]*"[^>]*>(.*?)</p>', "\n\\$\\$$1\\$\\$\n")
    for tag, to in (("sup", r"^{$1}"), ("sub", "_{$1}"), ("strong", r"\\mathbf{$1}"), ("em", "$1")):
        c = F.regexp_replace(c, rf"(?i)<{tag}>([^<]*)</{tag}>", to)
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n"), r"<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(html_unescaped(c), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def answer_in(c: Column) -> tuple[Column, Column]:
    """The letter that a text gives as its answer, and the place of that option; null without one."""
    letter = F.upper(F.nullif(F.regexp_extract(c, ANSWER, 1), F.lit("")))
    return letter, F.ascii(letter) - 65



def _with_powers(text: str | None) -> str | None:
    if text is None:
        return None

    def power(m: re.Match) -> str:
        near = text[max(0, m.start() - AROUND) : m.end() + AROUND]
        return f"{m[1]}^{m[2]}" if LATEX_SIGN.search(near) or OPERATOR.search(HIDING.sub("", near)) else m[0]

    return POWER.sub(power, text)


#: Text whose shorthand powers (x2) are written out (x^2) where signs of mathematics stand near;
#: those in addresses, paths and tags do not count.  Null stays null.
with_powers = F.udf(_with_powers, returnType=StringType(), useArrow=True)
