"""Language identification by interpolated Kneser-Ney character models.

A model holds, per order, the n-grams seen in any language as one sorted array of hashes
with a column of log2 probabilities for each language, and the same for the contexts'
back-off weights.  Characters are predicted inside words (letters, in lower case, with
marks for their begin and end), so a word's cost is found once and used for every
occurrence.  The language with the lowest cost per symbol wins; a text whose cost is far
above what held-out texts of that language have is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal, small_batches
from .words import mix

ORDER = 5
#: Labelled documents of each language that a model is fitted to, about; more are sampled by hash.
TRAIN_DOCS = 1000
#: And held out of those, to calibrate rejection.
CALIBRATION_DOCS = 300
#: Rejection: so many deviations above the mean cost of the language's held-out texts.
DEVIATIONS = 6.0
#: Words whose costs a task remembers.
CACHE = 200_000

#: A word is a letter and the letters and marks that follow, by Unicode category.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BEGIN, _END = 1, 2


def split(text: str | None) -> list[str]:
    """Words of a text, in lower case: the same for training and prediction."""
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # per order: sorted hashes of n-grams
    probs: list[np.ndarray]  # log2 p, NaN where the language has not seen it
    contexts: list[np.ndarray]  # per order from 2: sorted hashes of contexts
    weights: list[np.ndarray]  # log2 back-off weight, 0 where not seen
    floor: float  # log2 p of a character that no language has seen
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words one after the other, each with ORDER - 1 begin marks and an end;
    and a flag for those that are predicted."""
    joined = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(3)
    ends = np.flatnonzero(joined == 3)
    sizes = np.diff(np.concatenate(([-1], ends, [len(joined)]))) - 1
    total = sizes + ORDER
    out = np.full(total.sum(), _BEGIN, np.uint64)
    predicted = np.zeros(len(out), bool)
    last = np.cumsum(total) - 1
    out[last] = _END
    inside = np.repeat(last - sizes, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    out[inside] = joined[joined != 3]
    predicted[inside] = predicted[last] = True
    return out, predicted


def _grams(symbols: np.ndarray, predicted: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` symbols that end at each predicted one."""
    at = np.flatnonzero(predicted)
    h = np.zeros(len(at), np.uint64)
    for back in range(order - 1, -1, -1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + symbols[at - back]
    return mix(h + np.uint64(order << 56))


def _contexts(symbols: np.ndarray, predicted: np.ndarray, order: int) -> np.ndarray:
    at = np.flatnonzero(predicted)
    h = np.zeros(len(at), np.uint64)
    for back in range(order - 1, 0, -1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + symbols[at - back]
    return mix(h + np.uint64(order << 56) + np.uint64(1 << 63))


def _fit_language(words: list[str], counts: np.ndarray, alphabet: int) -> list[tuple]:
    """Per order (gram keys, p, context keys, back-off weights) of one language.

    The highest order uses counts, the lower ones the number of distinct symbols before;
    each takes a discount n1 / (n1 + 2 n2) and gives its mass to the order below.
    """
    symbols, predicted = _symbols(words)
    sizes = np.array([len(w) + 1 for w in words])
    weight = np.repeat(counts, sizes).astype(np.float64)
    orders, lower = [], {}
    grams = [_grams(symbols, predicted, k) for k in range(1, ORDER + 1)]
    for k in range(1, ORDER + 1):
        keys, first, inverse = np.unique(grams[k - 1], return_index=True, return_inverse=True)
        if k == ORDER:
            n = np.bincount(inverse, weight)
        else:  # distinct (k + 1)-grams that end in each k-gram
            _, one = np.unique(grams[k], return_index=True)
            n = np.bincount(inverse[one], minlength=len(keys)).astype(np.float64)
        n1, n2 = (n == 1).sum(), (n == 2).sum()
        d = float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5
        if k == 1:
            p = np.maximum(n - d, 0) / n.sum() + d * len(keys) / n.sum() / alphabet
            orders.append((keys, p, None, None))
            continue
        ctx = _contexts(symbols, predicted, k)[first]
        below = grams[k - 2][first]
        ckeys, cinv = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(cinv, n), np.bincount(cinv)
        gamma = d * kinds / total
        pk, pp = orders[k - 2][0], orders[k - 2][1]
        p = np.maximum(n - d, 0) / total[cinv] + gamma[cinv] * pp[np.searchsorted(pk, below)]
        orders.append((keys, p, ckeys, gamma))
    return orders


def _fitted(alphabet: int):
    """(lang, w, count) rows of one language to its arrays, a row for each order."""

    def run(words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("w")
        orders = _fit_language(words["w"].tolist(), words["count"].to_numpy(), alphabet)
        raw = lambda a: None if a is None else a.tobytes()
        rows = [(words["lang"].iloc[0], k, *(raw(a) for a in arrays)) for k, arrays in enumerate(orders, 1)]
        return pd.DataFrame(rows, columns=["lang", "k", "keys", "p", "contexts", "gamma"])

    return run


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    out = np.full((len(keys), len(parts)), missing, np.float32)
    for i, (k, v) in enumerate(parts):
        out[np.searchsorted(keys, k), i] = np.log2(v)
    return keys, out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_costs(model: Model, words: list[str]) -> np.ndarray:
    """Bits of each word in each language, its end included."""
    symbols, predicted = _symbols(words)
    at, seen = _lookup(model.keys[0], _grams(symbols, predicted, 1))
    lp = np.where(seen[:, None], model.probs[0][at], np.nan)
    lp = np.where(np.isnan(lp), model.floor, lp)
    for k in range(2, ORDER + 1):
        at, seen = _lookup(model.contexts[k - 2], _contexts(symbols, predicted, k))
        lp = lp + np.where(seen[:, None], model.weights[k - 2][at], 0)
        at, seen = _lookup(model.keys[k - 1], _grams(symbols, predicted, k))
        p = np.where(seen[:, None], model.probs[k - 1][at], np.nan)
        lp = np.where(np.isnan(p), lp, p)
    sizes = np.array([len(w) + 1 for w in words])
    return -np.add.reduceat(lp, np.cumsum(sizes) - sizes, axis=0)


JUDGED = "lang_pred string, score double, cost double, n_symbols bigint, rejected boolean"


def _judge(model_of, text_at: int):
    """Add the columns of `JUDGED` to rows whose text is at `text_at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of.value
        known: dict[str, int] = {}
        costs = np.zeros((0, len(model.langs) + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                if len(known) > CACHE:
                    known, costs = {}, costs[:0]
                fresh: list[str] = []
                docs = []
                for text in part.column(text_at).to_pylist():
                    row = []
                    for w in split(text) if model.langs else ():
                        i = known.get(w)
                        if i is None:
                            i = known[w] = len(known)
                            fresh.append(w)
                        row.append(i)
                    docs.append(row)
                if fresh:
                    costs = np.concatenate([costs, np.column_stack([word_costs(model, fresh), [len(w) + 1 for w in fresh]])])
                rows = []
                for row in docs:
                    if not row:
                        rows.append(("und", 0.0, None, 0, bool(model.langs)))
                        continue
                    total = costs[row].sum(axis=0)
                    n = int(total[-1])
                    ce = total[:-1] / n
                    best = int(np.argmin(ce))
                    p = 1 / np.exp2(-(ce - ce[best]) * min(n, 60)).sum()
                    limit = model.mean[best] + DEVIATIONS * (model.spread[best] + model.noise[best] / np.sqrt(n))
                    rows.append((model.langs[best], float(p), float(ce[best]), n, bool(ce[best] > limit)))
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
                more = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *(x.split()[0] for x in JUDGED.split(", "))])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to words of each language and their numbers."""
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update((lang, w) for w in split(text))
        if found:
            lang, w = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(w), pa.array(list(found.values()), pa.int64())], ["lang", "w", "n"])


def train(labelled: DataFrame, per_lang: int = TRAIN_DOCS) -> Model:
    """Fit a model to text and lang of labelled documents (doc_id, text, lang).

    Rows without text or lang are left out.  Of a language with more rows than `per_lang`,
    about so many are taken by a hash of doc_id; that sample is what reaches the driver.
    A language whose sample has no letters is not learned; without any, the model knows none.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not held:
        return Model([], [], [], [], [], -30.0, *(np.zeros(0) for _ in range(3)))
    spark = labelled.sparkSession
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lang")), F.lit(1_000_000)) / 1_000_000
    rate = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, (per_lang + CALIBRATION_DOCS) / n))) for k, n in sorted(held.items())))
    apart = per_lang / (per_lang + CALIBRATION_DOCS)
    fit = rows.where(u < rate * apart)
    calibrate = rows.where((u >= rate * apart) & (u < rate))
    counts = fit.select("lang", "text").mapInArrow(frugal(_counted), "lang string, w string, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("count"))
    letters = counts.select(F.explode(F.split("w", "")).alias("c")).where("c <> ''").agg(F.count_distinct("c")).first()[0]
    alphabet = letters + 2
    # One task a language, with the distinct words of its sample; only the finished arrays reach the driver.
    fitted = counts.groupBy("lang").applyInPandas(_fitted(alphabet), "lang string, k int, keys binary, p binary, contexts binary, gamma binary").collect()
    langs = sorted({r["lang"] for r in fitted})
    if not langs:
        return Model([], [], [], [], [], -30.0, *(np.zeros(0) for _ in range(3)))
    by = {(r["lang"], r["k"]): r for r in fitted}
    pairs = lambda k, a, b: [(np.frombuffer(by[g, k][a], np.uint64), np.frombuffer(by[g, k][b], np.float64)) for g in langs]
    keys, probs = zip(*(_merge(pairs(k, "keys", "p"), np.nan) for k in range(1, ORDER + 1)), strict=True)
    contexts, weights = zip(*(_merge(pairs(k, "contexts", "gamma"), 0.0) for k in range(2, ORDER + 1)), strict=True)
    del fitted, by
    n = len(langs)
    model = Model(langs, list(keys), list(probs), list(contexts), list(weights), -np.log2(alphabet) - 8, np.full(n, np.inf), np.zeros(n), np.zeros(n))
    sent = spark.sparkContext.broadcast(model)
    seen = judged(calibrate.select("lang", "text"), sent).where("lang = lang_pred").select("lang", "cost", "n_symbols").toPandas()
    sent.destroy()
    # A language with few calibration texts takes the limits of all languages' together.
    for i, lang in enumerate(langs):
        own = seen[seen["lang"] == lang]
        own = own if len(own) >= 10 else seen
        if len(own) < 10:
            continue  # too few in all: nothing is rejected for its cost
        long = own["cost"][own["n_symbols"] >= own["n_symbols"].median()]
        model.mean[i], model.spread[i] = own["cost"].median(), max(0.05, float(long.std()))
        model.noise[i] = max(0.5, float(((own["cost"] - model.mean[i]) * np.sqrt(own["n_symbols"])).std()))
    return model


def judged(docs: DataFrame, model) -> DataFrame:
    """`docs` (text, any others) with the columns of `JUDGED`, which replace any of these names.

    Null texts and texts without letters are `und` with score 0, cost null, and rejected.  A
    model that knows no language gives `und` to all and rejects nothing.  Whole texts are read,
    each row by itself; ties between languages go to the first by name.
    """
    docs = docs.drop(*(x.split()[0] for x in JUDGED.split(", ")))
    sent = docs.sparkSession.sparkContext.broadcast(model) if isinstance(model, Model) else model
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(JUDGED).fields])
    return small_batches(docs).mapInArrow(frugal(_judge(sent, docs.columns.index("text"))), schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cost (bits a symbol), n_symbols and rejected per row,
    as `judged` says; other columns of docs are ignored."""
    return judged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model).drop("text")
