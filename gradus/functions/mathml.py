"""Mathematics of word processors and browsers (OMML, MathML) as LaTeX: a fold of their trees.

An element takes its folded children and gives what the rule of its kind makes of them: each at
its end while markup is read, or from the last node to the first of a node array.  An Arrow
function does so for a batch of pages; the same rules as column expressions took thirty times as
long, since Spark interprets the lambdas of folds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, partial
from typing import NamedTuple

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..sources.markup import TAG_NAME, attributes_of, formula_spans, parsed

# Operators, functions, marks over a letter, and signs of sums, as LaTeX.
OPERATORS = {"⋂": r"\cap", "⋃": r"\cup", "×": r"\times", "÷": r"\div", "±": r"\pm", "→": r"\rightarrow", "⇒": r"\Rightarrow", "≠": r"\neq", "≤": r"\le", "≥": r"\ge", "∞": r"\infty", "&InvisibleTimes;": ""}
FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "lim", "det", "max", "min")
OVER = {"vec": ("→", r"\rightarrow", "⃗"), "hat": ("^", "̂", "hat"), "bar": ("¯", "̄", "bar", "‾")}
LARGE = {"∫": r"\int", "Integral": r"\int", "∑": r"\sum", "Sum": r"\sum", "∏": r"\prod", "Product": r"\prod"}
SPACED = ("math", "mrow", "mtr", "mtd")
#: Tags up to so many characters are read once for many.
TAG = 200



class Folded(NamedTuple):
    """A folded node: its kind, LaTeX by its own rule and that of its content, plain text of both,
    its texts, its attributes, its children."""

    kind: str
    latex: str
    inner: str
    plain: str
    inner_plain: str
    texts: str
    attributes: dict
    kids: tuple


def balanced(s: str) -> bool:
    """Whether braces in a string close what they open."""
    depth = 0
    for c in s:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return False
    return depth == 0


_NONE = Folded("", "", "", "", "", "", {}, ())
_light = partial(tuple.__new__, Folded)


def _joined(parts, sep: str) -> str:
    return sep.join(x for x in parts if x)


class Kids:
    """A node's children by name and by place; those that are missing are empty."""

    def __init__(self, kids: tuple, attributes: dict, texts: str):
        self.all, self.attributes, self.texts, self.word = kids, attributes, texts, texts and texts.strip()

    def has(self, kind: str) -> bool:
        return any(k.kind == kind for k in self.all)

    def named(self, kind: str) -> list[Folded]:
        return [k for k in self.all if k.kind == kind]

    def __getitem__(self, key: str | int) -> Folded:
        if isinstance(key, int):
            return self.all[key] if key < len(self.all) else _NONE
        for k in self.all:
            if k.kind == key:
                return k
        return _NONE

    def value(self, properties: str, kind: str) -> str:
        """The `val` of a property: a child of the child that holds properties."""
        held = next((k for k in self[properties].kids if k.kind == kind), _NONE)
        return held.attributes.get("val", "")

    def spaced(self) -> str:
        return _joined((k.latex for k in self.all), " ")


def _fenced(left: str, right: str, body: str) -> str:
    sign = lambda c: f"\\{c}" if c in "{}" else c
    return f"\\left{sign(left)} {body} \\right{sign(right)}"


def _over(mark: str, body: str) -> str:
    kind = next((k for k, marks in OVER.items() if mark in marks), None)
    return f"\\{kind}{{{body}}}" if kind else f"\\overset{{{mark}}}{{{body}}}"


def _cells(rows: list[Folded], cell: str, field: str) -> list[list[str]]:
    return [[getattr(k, field) for k in r.kids if k.kind == cell] for r in rows]


def _matrix(row: str, cell: str, field: str) -> tuple[Callable, Callable]:
    tex = lambda k: "\\begin{matrix}" + " \\\\ ".join(" & ".join(c) for c in _cells(k.named(row), cell, field)) + "\\end{matrix}"
    return tex, lambda k: [x for c in _cells(k.named(row), cell, "inner_plain") for x in c]


def _identifier(word: str) -> str:
    if len(word) < 2 or word.startswith("\\"):
        return word
    return f"\\{word}" if word in FUNCTIONS else f"\\text{{{word}}}"


def _large(k: Kids) -> str:
    sign = k.value("narypr", "chr")
    limits = (f"_{{{k['sub'].inner}}}" if k.has("sub") else "") + (f"^{{{k['sup'].inner}}}" if k.has("sup") else "")
    return (LARGE.get(sign, sign) if sign else "\\sum") + limits + " " + k["e"].inner


def _root(index: str | None, body: str) -> str:
    return f"\\sqrt{{{body}}}" if index is None else f"\\sqrt[{index}]{{{body}}}"


def _by(*kinds: str) -> Callable[[Kids], list[str]]:
    return lambda k: [k[x].inner_plain for x in kinds]


def _at(*places: int) -> Callable[[Kids], list[str]]:
    return lambda k: [k[i].plain for i in places]


def _all(k: Kids) -> list[str]:
    return [x.plain for x in k.all]


#: The rule of a kind: its LaTeX, and its plain text in parts.
RULES: dict[str, tuple[Callable[[Kids], str], Callable[[Kids], list[str]]]] = {
    "#text": (lambda k: k.texts, lambda k: [k.texts]),
    "t": (lambda k: k.texts, lambda k: [k.texts]),
    "mi": (lambda k: _identifier(k.word), lambda k: [k.word]),
    "mn": (lambda k: k.word, lambda k: [k.word]),
    "mo": (lambda k: OPERATORS.get(k.word, k.word), lambda k: [k.word]),
    "mtext": (lambda k: f"\\text{{{k.texts}}}", lambda k: [k.texts]),
    "math": (lambda k: f"\n$${k.spaced()}$$\n" if k.attributes.get("display") == "block" else f"${k.spaced()}$", _all),
    "f": (lambda k: f"\\frac{{{k['num'].inner}}}{{{k['den'].inner}}}", _by("num", "den")),
    "mfrac": (lambda k: f"\\frac{{{k[0].latex}}}{{{k[1].latex}}}", _at(0, 1)),
    "ssup": (lambda k: f"{k['e'].inner}^{{{k['sup'].inner}}}", _by("e", "sup")),
    "msup": (lambda k: f"{k[0].latex}^{{{k[1].latex}}}", _at(0, 1)),
    "ssub": (lambda k: f"{k['e'].inner}_{k['sub'].inner}", _by("e", "sub")),
    "msub": (lambda k: f"{k[0].latex}_{k[1].latex}", _at(0, 1)),
    "ssubsup": (lambda k: f"{k['e'].inner}_{{{k['sub'].inner}}}^{{{k['sup'].inner}}}", _by("e", "sup", "sub")),
    "msubsup": (lambda k: f"{k[0].latex}_{{{k[1].latex}}}^{{{k[2].latex}}}", _at(0, 2, 1)),
    "rad": (lambda k: _root(k["deg"].inner if k.has("deg") else None, k["e"].inner), _by("e", "deg")),
    "msqrt": (lambda k: _root(None, k.spaced()), _all),
    "mroot": (lambda k: _root(k[1].latex if len(k.all) > 1 else None, k[0].latex), _at(0, 1)),
    "nary": (_large, _by("sup", "sub", "e")),
    "d": (lambda k: _fenced(k.value("dpr", "begchr") or "(", k.value("dpr", "endchr") or ")", k["e"].inner), _by("e")),
    "mfenced": (lambda k: _fenced(k.attributes.get("open") or "(", k.attributes.get("close") or ")", k.spaced()), _all),
    "m": _matrix("mr", "e", "inner"),
    "mtable": _matrix("mtr", "mtd", "latex"),
    "eqarr": (lambda k: "\\begin{aligned}" + " \\\\ ".join(e.inner for e in k.named("e")) + "\\end{aligned}", lambda k: [e.inner_plain for e in k.named("e")]),
    "acc": (lambda k: _over((k.value("accpr", "chr") or "→").strip(), k["e"].inner), _by("e")),
    "mover": (lambda k: _over(k[1].texts.strip(), k[0].latex), _at(0)),
    "munder": (lambda k: f"\\underset{{{k[1].latex}}}{{{k[0].latex}}}", _at(0, 1)),
    "munderover": (lambda k: f"{k[0].latex}_{{{k[1].latex}}}^{{{k[2].latex}}}", _at(0, 1, 2)),
}
RULES |= {"sup": RULES["ssup"], "sub": RULES["ssub"]}


def _fold(kind: str, text: str | None, attributes: dict, kids: tuple, braces: bool = True) -> Folded:
    """A node with its folded children: the rule of its kind, or plain text where the braces of
    what it gives do not balance.  Kinds without a rule are their content.  Rules balance braces,
    so that what has no `braces` of its own needs no plain text."""
    texts = text or "" if kind == "#text" else "".join([k.texts for k in kids if k.kind == "#text"]) if kids else ""
    rule = RULES.get(kind)
    if not braces:
        inner = kids[0].latex if len(kids) == 1 else "".join([x.latex for x in kids])
        if rule:
            latex = rule[0](Kids(kids, attributes, texts))
        else:
            latex = _joined((x.latex for x in kids), " ") if kind in SPACED else inner
        return _light((kind, latex, inner, "", "", texts, attributes, kids))
    k = Kids(kids, attributes, texts)
    inner_plain = _joined(_all(k), " ")
    joined = _joined((x.latex for x in kids), "")
    inner = joined if balanced(joined) else inner_plain
    if rule:
        latex, plain = rule[0](k), _joined(rule[1](k), " ")
    else:
        latex, plain = (k.spaced() if kind in SPACED else joined), inner_plain
    return Folded(kind, latex if balanced(latex) else plain, inner, plain, inner_plain, texts, attributes, kids)


def _kind(name: str) -> str:
    return name.lower().rpartition(":")[2]


def latex_of(nodes: list[dict]) -> str | None:
    """LaTeX of the first tree of parsed nodes; None without one.  Blank texts are none."""
    root = next((n["root"] for n in nodes if n["root"] >= 0), None)
    done: list[tuple[int, Folded]] = []  # the next node's children come last
    for n in reversed(nodes):
        if n["root"] != root or n["name"].startswith("#") and not (n["text"] or "").strip():
            continue
        kids = []
        while done and done[-1][0] > n["depth"]:
            kids.append(done.pop()[1])
        done.append((n["depth"], _fold(_kind(n["name"]), n["text"], n["attributes"] or {}, tuple(kids))))
    return done[-1][1].latex if done else None


@lru_cache(1024)
def _tag(said: str) -> tuple[str, dict, bool]:
    """Kind, attributes and whether it is empty, of what a start tag says."""
    tag = TAG_NAME.match(said)
    name = tag[0] if tag else ""
    return _kind(name), attributes_of(said[len(name) :]), said.endswith("/")


#: A run of one text, which is folded at once where braces are free to mark it.
_RUN = re.compile(r"<m:r>\s*<m:t>([^<>]*)</m:t>\s*</m:r>")
_NOTHING: dict = {}


def _markup_latex(raw: str) -> str | None:
    """As `latex_of` of parsed XML, folded while it is read, each element at its end."""
    braces = "{" in raw or "}" in raw
    said = (raw if braces else _RUN.sub(r"<{\1>", raw)).split("<")
    if "<!" in raw or "<?" in raw or not all([">" in x for x in said[1:]]):
        return latex_of(parsed(raw))
    outer: list[tuple[str, dict, list]] = []  # open elements around the one that `kids` belongs to
    kind, attributes, kids = "", {}, None
    for x in said[1:]:
        tag, _, text = x.partition(">")
        if tag[:1] == "{" and not braces:
            if kids is None:
                return tag[1:].lstrip()
            kids.append(_light(("r", tag[1:].lstrip(), "", "", "", "", _NOTHING, ())))
        elif tag[:1] == "/":
            if kids is None:
                continue
            node = _fold(kind, None, attributes, kids, braces)
            kind, attributes, kids = outer.pop()
            if kids is None:
                return node.latex
            kids.append(node)
        else:
            found, own, empty = _tag(tag) if len(tag) < TAG else _tag.__wrapped__(tag)
            if not empty:
                outer.append((kind, attributes, kids))
                kind, attributes, kids = found, own, []
            elif kids is None:
                return _fold(found, None, own, (), braces).latex
            else:
                kids.append(_fold(found, None, own, (), braces))
        if text and kids is not None and (text := text.lstrip()):
            kids.append(_fold("#text", text, _NOTHING, (), True) if braces else _light(("#text", text, "", "", "", text, _NOTHING, ())))
    node = None
    while kids is not None:
        node = _fold(kind, None, attributes, kids, braces)
        kind, attributes, kids = outer.pop()
        if kids is not None:
            kids.append(node)
    return node and node.latex


def formula(raw: str) -> str | None:
    """A formula's markup as LaTeX in dollars: two for displayed ones, on lines of their own.  None
    without a tree."""
    tex = _markup_latex(raw)
    if tex is None:
        return None
    low = raw.lower()
    if "omathpara" in low or 'display="block"' in low:
        return f"\n$${tex.strip()}$$\n"
    return tex if tex.startswith("$") else f"${tex.strip()}$"


@F.udf(returnType=StringType(), useArrow=True)
def page_with_latex(html):
    """A page whose formulas are LaTeX; those without a tree stay as they are.  Null stays null."""
    if html is None:
        return None
    out, at = [], 0
    for start, end in formula_spans(html):
        raw = html[start:end]
        out += [html[at:start], formula(raw) or raw]
        at = end
    return "".join(out) + html[at:]


@F.udf(returnType=ArrayType(StructType([StructField("raw", StringType()), StructField("latex", StringType())])), useArrow=True)
def formulas(html):
    """The formulas of a page, in order: markup and LaTeX."""
    return None if html is None else [{"raw": html[a:b], "latex": formula(html[a:b])} for a, b in formula_spans(html)]


@F.udf(returnType=StringType(), useArrow=True)
def nodes_latex(nodes):
    """LaTeX of a node array, without dollars."""
    return None if nodes is None else latex_of([n if isinstance(n, dict) else n.asDict() for n in nodes])
