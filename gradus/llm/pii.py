"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Words without a digit or an at sign are outside any span by rule, so that the chain falls
apart at them and only the runs between them are decoded, in batches of equal length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Made rows of each kind in the labelled table.
LABELLED = 60
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# A small labelled table.  {} stands for each example of a kind.
EXAMPLES = {
    "email": ["ann.lee@mail.example.org", "j_doe@example.com", "info@firma.example.de", "maria+news@correo.example.es", "root@localhost", "x.y@intranet"],
    "ip": ["10.0.0.1", "192.168.14.250", "227.5.221.1", "8.8.8.8", "172.16.254.3"],
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "6011 0009 9013 9424", "4012888888881881"],
    "phone": ["+1 (743) 555-3824", "+44 20 7946 0958", "(212) 555-0147", "030 901820 44", "+49 30 123456", "555-0142-998", "(030) 5555-7788", "+34 915 550 123"],
}
TEMPLATES = ["write to {} today", "contact : {}", "the {} , and", "le {} de la", "reach me at {} .", "{} und der", "from {} to", "tel {} or mail", "es {} que", "number {} was"]
PLAIN = [
    "on 2024-01-05 it was", "at 10:30 the", "version 1.2.3 of", "price 12.99 and", "about 1,234,567 people", "page 12 of 340", "in 1998 and 2003", "chapter 3 section 4", "5 6 7 8 9 10", "10 20 30 40",
    "0.75 0.25 0.5", "see [12] and [13]", "$ 400 or 3 %", "room 101 on 5th", "a 16-bit or 32-bit", "id 48213 in list", "no 7 and 12 , 15", "user@ or @home", "1999-2004 and 2010/11", "x1 y2 z3", "score 3-2 and 4-1", "lines 100-200", "code 12345 is", "sum 1000000000000 of", "12 34 56 78", "v2.0.1 , 3.14159",
]

# How personal data and other numbers are written; # is a digit, ~ a letter.
FORMATS = {
    "email": ["~~~.~~~~@mail#.example.org", "~~~~_##@~~~~.example.com", "~~~@~~~~", "~~~~##@intranet", "~.~~~~~@~~~~-~~.example.de"],
    "ip": ["10.#.#.##", "192.168.#.1##", "172.16.##.#", "8.#.#.#", "2##.1##.##.1"],
    "card": ["4### #### #### ####", "5###-####-####-####", "4###############", "37#############"],
    "phone": ["+1 (###) ###-####", "+44 20 #### ####", "(###) ###-####", "0## ######", "###-###-####", "+49 ## ######", "(0##) ####-####", "0## #### ####"],
}
OTHERS = ["19##-0#-1#", "20##", "#.#.##", "v#.#", "##.##", "#,###", "## %", "p. ##-##", "[##]", "#:##", "id #####", "##/##", "#-#", "##-bit", "$ ###", "x#", "#### kg", "###### lines"]
_TOKEN = re.compile(r"\S+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])" + IP.pattern)
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, in order.  A match has one at sign and what of its word stands before it:
    from each at sign back once, to the end of the last match at most, and on from there."""
    after, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > after and text[lo - 1] in _LOCAL:
            lo -= 1
        m = EMAIL.match(text, lo) if lo < at else None
        if m:
            yield m.span()
            after = m.end()
        at = text.find("@", max(after, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start.

    The time is in proportion to the text: an e-mail address is read from its at sign, and an
    address of numbers begins where a run of digits does, since a match from inside a run would be
    part of one from there; runs that are looked at again are at most three.
    """
    out = [(0, *span) for span in email_spans(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = re.sub(r"[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape(word: str) -> str:
    """Upper case X, lower case x, digits d, other characters as they are; runs of x and X are
    one, runs of digits keep their length up to 5."""
    s = re.sub(r"[0-9]{6,}", "ddddd", word)
    s = re.sub(r"[0-9]", "d", s)
    s = re.sub(r"[^\W\d_]+", lambda m: "".join("d" if c == "d" and m[0].strip("d") == "" else "x" for c in m[0]) if m[0].strip("d") == "" else "x", s)
    return s


def features(words: list[str], i: int) -> list[str]:
    w, s = words[i], shape(words[i])
    digits = sum(c.isdigit() for c in w)
    before = shape(words[i - 1]) if i else "^"
    after = shape(words[i + 1]) if i + 1 < len(words) else "$"
    near = lambda x: "num" if any(c in "d" for c in x) and "x" not in x else "mix" if "d" in x else "word"
    return [
        "bias", f"s={s}", f"n={min(digits, 16)}", f"at={'@' in w}", f"plus={w.startswith('+')}", f"paren={w.startswith('(')}", f"dots={min(w.count('.'), 4)}", f"dash={min(w.count('-'), 3)}",
        f"alpha={any(c.isalpha() for c in w)}", f"b={before if near(before) == 'num' else near(before)}", f"a={after if near(after) == 'num' else near(after)}", f"bn={near(before)}/{min(digits, 8)}", f"an={near(after)}/{min(digits, 8)}",
    ]


@dataclass
class Field:
    index: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels
    start: np.ndarray


def labelled() -> list[tuple[list[str], list[int]]]:
    """The labelled table: words and labels of each row."""
    rows = [(p.split(), [0] * len(p.split())) for p in PLAIN for _ in range(2)]
    for k, kind in enumerate(KINDS):
        for e, example in enumerate(EXAMPLES[kind]):
            for t in range(4):
                left, right = TEMPLATES[(3 * e + 5 * t + k) % len(TEMPLATES)].split("{}")
                inner = example.split()
                words = left.split() + inner + right.split()
                y = [0] * len(left.split()) + [1 + 2 * k] + [2 + 2 * k] * (len(inner) - 1) + [0] * len(right.split())
                rows.append((words, y))
    return rows


def made(seed: int, each: int) -> list[tuple[list[str], list[int]]]:
    """Rows made from `FORMATS` and `OTHERS`, `each` of a kind, in the templates' sentences."""
    rng = random.Random(seed)
    written = lambda f: "".join(str(rng.randrange(10)) if c == "#" else rng.choice("abcdefghiklmnoprstu") if c == "~" else c for c in f)
    rows = []
    for k, kind in enumerate([*KINDS, None]):
        for i in range(each):
            formats = FORMATS[kind] if kind else OTHERS
            inner = written(formats[i % len(formats)]).split()
            if kind == "card":  # numbers of cards pass a check of their digits
                while not luhn("".join(c for w in inner for c in w if c.isdigit())):
                    inner = written(formats[i % len(formats)]).split()
            left, right = rng.choice(TEMPLATES).split("{}")
            y = [1 + 2 * k] + [2 + 2 * k] * (len(inner) - 1) if kind else [0] * len(inner)
            rows.append((left.split() + inner + right.split(), [0] * len(left.split()) + y + [0] * len(right.split())))
    return rows


def fit(rows: list[tuple[list[str], list[int]]] | None = None, steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of the labelled rows by Adam steps."""
    rows = rows or labelled() + made(1, LABELLED)
    names = sorted({f for w, _ in rows for i in range(len(w)) for f in features(w, i)})
    index = {f: i for i, f in enumerate(names)}
    n, t, m = len(LABELS), max(len(w) for w, _ in rows), len(rows)
    x = np.zeros((m, t, len(names)), np.float32)
    y = np.zeros((m, t), int)
    mask = np.zeros((m, t), bool)
    for r, (w, labels) in enumerate(rows):
        for i in range(len(w)):
            x[r, i, [index[f] for f in features(w, i)]] = 1
        y[r, : len(w)], mask[r, : len(w)] = labels, True
    params = [np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sum_exp = lambda a, axis: (top := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis))
    hot = np.eye(n)[y] * mask[..., None]
    for step in range(1, steps + 1):
        emit, move, start = params
        e = x @ emit
        alpha, beta = np.zeros((m, t, n)), np.zeros((m, t, n))
        alpha[:, 0] = start + e[:, 0]
        for i in range(1, t):
            new = sum_exp(alpha[:, i - 1, :, None] + move, 1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
        z = sum_exp(alpha[:, -1], 1)
        for i in range(t - 2, -1, -1):
            new = sum_exp(move + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None], new, 0)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gold = np.einsum("mti,mtj->ij", hot[:, :-1], hot[:, 1:])
        grads = [np.einsum("mtf,mtn->fn", x, hot - p), gold - pair.sum((0, 1)), (hot[:, 0] - p[:, 0]).sum(0)]
        for q, g, a, b in zip(params, grads, first, second, strict=True):
            g = g / m - decay * q
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(index, *params)


def viterbi(field: Field, e: np.ndarray) -> np.ndarray:
    """Best labels of rows of equal length: scores (rows, length, labels)."""
    best = field.start + e[:, 0]
    back = []
    for i in range(1, e.shape[1]):
        reach = best[:, :, None] + field.move
        back.append(reach.argmax(1))
        best = reach.max(1) + e[:, i]
    out = [best.argmax(1)]
    for b in reversed(back):
        out.append(b[np.arange(len(b)), out[-1]])
    return np.stack(out[::-1], 1)


def _runs(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]], int, int]]:
    """Runs of words with a digit or at sign, with a word before and after: words, places,
    and where in them the run begins and ends."""
    at, tokens = 0, []
    mark = _MARK.search(text)
    while mark:
        lo = mark.start()
        while lo > at and not text[lo - 1].isspace():
            lo -= 1
        before = text[max(at, lo - 40) : lo].split()[-1:]
        words, places = list(before), [(0, 0)] * len(before)
        end = lo
        while True:
            m = _TOKEN.search(text, end)
            if not m or not _MARK.search(m[0]):
                break
            words.append(m[0])
            places.append(m.span())
            end = m.end()
        stop = len(words)
        words += text[end : end + 40].split()[:1]
        yield words, places, len(before), stop
        at = end
        mark = _MARK.search(text, end)


def _plausible(kind: int, span: str) -> bool:
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    if kind == 0:
        return span.count("@") == 1 and not span.startswith("@") and not span.endswith("@")
    if kind == 1:
        return bool(IP.fullmatch(span)) and all(int(x) <= 255 for x in span.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not luhn(digits) * (len(digits) > 12)


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """Base spans, and all spans, of each text: (kind, start, end) by kind and start.

    A span of the field is added where it overlaps no base span and has the characters that
    its kind needs; quotes, brackets and stops around its words are left out.
    """
    base = [base_spans(t) for t in texts]
    groups: dict[int, list] = {}
    for d, text in enumerate(texts):
        for words, places, lo, hi in _runs(text):
            groups.setdefault(hi - lo, []).append((d, words, places, lo, hi))
    added: list[list] = [[] for _ in texts]
    for length, runs in groups.items():
        for s in range(0, len(runs), 2000):
            batch = runs[s : s + 2000]
            e = np.zeros((len(batch), length, len(LABELS)))
            for r, (_, words, _, lo, hi) in enumerate(batch):
                for i in range(lo, hi):
                    known = [field.index[f] for f in features(words, i) if f in field.index]
                    e[r, i - lo] = field.emit[known].sum(0)
            for (d, _, places, lo, _), y in zip(batch, viterbi(field, e), strict=True):
                i = 0
                while i < length:
                    if y[i] == 0:
                        i += 1
                        continue
                    kind, j = (y[i] - 1) // 2, i + 1
                    while j < length and y[j] == 2 + 2 * kind:
                        j += 1
                    a, b = places[lo + i][0], places[lo + j - 1][1]
                    span = texts[d][a:b]
                    a += len(span) - len(span.lstrip("\"'<[{,;:"))
                    b -= len(span) - len(span.rstrip("\"'>]},;:.!?"))
                    if b > a and _plausible(kind, texts[d][a:b]) and not any(a < y1 and x1 < b for _, x1, y1 in base[d]):
                        added[d].append((int(kind), a, b))
                    i = j
    return [(b, sorted(b + x)) for b, x in zip(base, added, strict=True)]


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each whole text.

    docs: doc_id, text; other columns are ignored.  Counts and digest are of the base patterns;
    spans has the field's as well.  Null texts are empty: no spans, and the digest of the empty
    string.  A row for each input row, repeated ones too, by its own whole text; no rows give none.  The field is
    fitted to the table `labelled()` on the driver, and sent to tasks (some hundred kB).
    """
    held = docs.sparkSession.sparkContext.broadcast(field or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = find([t or "" for t in part.column(1).to_pylist()], held.value)
                counts = [pa.array([sum(k == i for k, _, _ in b) for b, _ in found], pa.int64()) for i in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found])
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([_joined(x) for _, x in found])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
