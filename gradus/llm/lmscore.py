"""Language-model scoring by a weighted back-off automaton over words.

States are the empty history and the histories of one and two words that occur twice; an
arc reads a word and carries its log-probability, and a state's failure arc leads to the
shorter history with the weight of the mass it leaves over.  Every word, bigram and trigram
with two occurrences counts, however large the corpus is.

The log-probability of a text is a sum over its n-grams: a word brings that of its arc from
the empty history and its own failure weight; a bigram that is an arc brings what it gains
over backing off, and its failure weight as a history; a trigram what it gains.  So each
n-gram has one value.  Counts and values are tables; tasks hold the values of the HOT and
HOT_GRAMS most frequent n-grams of each order and Bloom filters of at most 2 ** BITS bits, which tell most
n-grams that have no value; all others are resolved by a join, each once a document with its
number there.  Both bound memory only, and change no result: where a filter would be full, there
is none, and all n-grams may have a value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back, shared_dir, small_batches, written
from .words import Table, Words, add_up, chunks, dealt, in_ranges, mix, unmix, words

#: Words whose values every task holds, at most 2 ** _ID; and pairs, and triples.
HOT, HOT_GRAMS = 1 << 20, 1 << 19
#: Bits of the filter of kept n-grams of an order, as a power of two, at most; and the ranges of
#: keys that have a part of it, as a power of two: with more of them (some 10^11 tokens) such a filter is full.
BITS, PARTS = 26, 16
#: What is taken off the count of each kept bigram and trigram.
DISCOUNT = 0.75
#: Keys that a counting task holds before it adds them up, and of a range that another adds up.
FLUSH, RANGE = 500_000, 1_000_000

_END = np.uint64(0)  # hash of the token that ends a text
_ID = 20  # bits of a hot word's number
_U = np.uint64
_TOP, _PAIR, _TRIPLE = _U(1 << 63), _U(1 << 61), _U(1 << 62)
_NUMBER = _U((1 << _ID) - 1)


class Filter(NamedTuple):
    """Bloom filter of two bits a key; both lie in the part that the key's leading bits name."""

    bits: np.ndarray  # bytes
    size: int  # as a power of two
    parts: int  # as a power of two

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set; never false for one that is."""
        out = self._at(keys >> _U(64 - self.size))
        some = np.flatnonzero(out)
        inner = self.size - self.parts
        k = keys[some]
        out[some] = self._at((k >> _U(64 - self.parts) << _U(inner)) | (k & _U((1 << inner) - 1)))
        return out

    def _at(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def _filter_part(keys: np.ndarray, size: int, parts: int) -> bytes:
    """The bits of one part, for its keys."""
    mask = _U((1 << size - parts) - 1)
    out = np.zeros(1 << size - parts, bool)
    out[((keys >> _U(64 - size)) & mask).astype(np.int64)] = True
    out[(keys & mask).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


@dataclass
class Automaton:
    n: int  # training tokens
    v: int  # distinct ones
    discount: float
    words: Table  # hashes of hot words; a place in it is the word's number
    counts: np.ndarray
    only_hot: bool = False  # no other words occur twice
    kept: Filter | None = None  # words, pairs, triples that occur twice; None: any may
    values: np.ndarray | None = None
    kept_pairs: Filter | None = None
    pairs: Table | None = None
    pair_values: np.ndarray | None = None
    kept_triples: Filter | None = None
    triples: Table | None = None
    triple_values: np.ndarray | None = None

    def base_logp(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))


class Grams(NamedTuple):
    """n-grams: where they begin, their keys, and what begins and ends them."""

    at: np.ndarray
    key: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    rare: np.ndarray  # whether head and tail cannot be read from the key

    def where(self, keep: np.ndarray) -> Grams:
        return Grams(*(c[keep] for c in self))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and ends in order, their documents, and each document's first token."""
    w: Words = words(texts)
    docs = len(w.first) - 1
    first = w.first + np.arange(docs + 1)
    h = np.full(len(w) + docs, _END, np.uint64)
    h[np.arange(len(w)) + w.doc] = w.hash
    return h, np.repeat(np.arange(docs), np.diff(first)), first


def _pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(_PAIR | (x << _U(_ID)) | y)


def _grams(a: Automaton, h: np.ndarray, doc: np.ndarray, order: int = 3) -> tuple[np.ndarray, Grams, Grams | None]:
    """Words' codes, and the pairs and, for order 3, triples that may be kept.

    A word's code is its number, or its hash with the top bit set; an n-gram of numbers is
    its key, unmixed.
    """
    at, seen = a.words.find(h)
    code = np.where(seen, at.astype(_U), h | _TOP)
    may = lambda f, keys: np.ones(len(keys), bool) if f is None else f.maybe(keys)
    kept = seen if a.only_hot else seen | may(a.kept, h)
    at = np.flatnonzero((doc[1:] == doc[:-1]) & kept[1:] & kept[:-1])
    x, y = code[at], code[at + 1]
    rare = (x | y) >= _TOP
    pairs = Grams(at, np.where(rare, mix(mix(x * _U(0x9E3779B97F4A7C15) + y) | _TOP), _pair_key(x, y)), x, y, rare)
    if order == 2:
        return code, pairs, None
    pairs = pairs.where(may(a.kept_pairs, pairs.key))
    at = np.flatnonzero(pairs.at[1:] == pairs.at[:-1] + 1)
    one, two = pairs.where(at), pairs.where(at + 1)
    rare = one.rare | two.rare
    exact = _TRIPLE | (one.head << _U(2 * _ID)) | (one.tail << _U(_ID)) | two.tail
    key = mix(np.where(rare, mix(one.key * _U(0xD6E8FEB86659FD93) + two.key) | _TOP, exact))
    triples = Grams(one.at, key, one.key, two.key, rare)
    return code, pairs, triples.where(may(a.kept_triples, key))


def _parts_of(order: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head and tail of n-grams of numbers."""
    k = unmix(key)
    x, y, z = (k >> _U(2 * _ID)) & _NUMBER, (k >> _U(_ID)) & _NUMBER, k & _NUMBER
    return (y, z) if order == 2 else (_pair_key(x, y), _pair_key(y, z))


_DEALT = "range int, once binary, more binary, times binary, rare binary"
_NAMES = ["range", "once", "more", "times", "rare"]


def _deal(grams_of: Callable[[pa.Array], Grams], bits: int):
    """Keys of the texts by their leading `bits`: those that the task met once, others with how
    often; and rare ones as rows of key, head, tail and number."""

    def flush(held: list[Grams]) -> Iterator[pa.RecordBatch]:
        key, head, tail, rare = (np.concatenate([g[i] for g in held]) for i in range(1, 5))
        found = dealt(key[~rare], bits)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array([b""] * found.num_rows, pa.binary())], _NAMES)
        k, first, n = np.unique(key[rare], return_index=True, return_counts=True)
        rows = np.column_stack([k, head[rare][first], tail[rare][first], n.astype(_U)])
        ranges, at = in_ranges(k, 64 - bits)
        if ranges:
            none = pa.array([b""] * len(ranges), pa.binary())
            cells = [rows[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), none, none, none, pa.array(cells, pa.binary())], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                held.append(grams_of(part))
                size += len(held[-1].key)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)
        del held
        give_back()

    return run


_COUNTED = "k bigint, h bigint, t bigint, n bigint, part int, bits binary"


def _counted(least: int, size: int, parts: int):
    """The n-grams of a range that occur `least` times, and the filter's part for those that do
    twice; head and tail of rare ones only, as others' keys have them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows[c]])
        k, n = add_up(read("once", _U), read("more", _U), read("times", "<u4"))
        k, n = k[n >= least], n[n >= least]
        rare = read("rare", _U).reshape(-1, 4)
        rk, first, which = np.unique(rare[:, 0], return_index=True, return_inverse=True)
        rn = np.bincount(which, rare[:, 3].astype(np.float64), len(rk)).astype(np.int64)
        keep = rn >= least
        n = np.concatenate([n, rn[keep]])
        bits = _filter_part(np.concatenate([k, rk[keep]])[n >= 2], size, parts) if size else None
        ends = [pa.concat_arrays([pa.nulls(len(k), pa.int64()), pa.array(rare[first, i][keep].view(np.int64))]) for i in (1, 2)]
        columns = [pa.array(np.concatenate([k, rk[keep]]).view(np.int64)), *ends, pa.array(n)]
        out = pa.table([*columns, pa.nulls(len(columns[0]), pa.int32()), pa.nulls(len(columns[0]), pa.binary())], [x.split()[0] for x in _COUNTED.split(", ")])
        one = pa.table([pa.nulls(1, pa.int64())] * 4 + [pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], out.column_names)
        del k, n, rare, rk, first, which, rn, columns, ends
        give_back()
        return pa.concat_tables([out, one])

    return run


def _ended(order: int):
    """Fill in heads and tails that the keys have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(_U)
            ends = [pc.coalesce(batch.column(i), pa.array(x.view(np.int64))) for i, x in enumerate(_parts_of(order, key), 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ends, batch.column(3)], ["k", "h", "t", "n"])

    return run


def _hot(rows: DataFrame, most: int, *columns: str) -> tuple[int, list[np.ndarray]]:
    """The n from which rows are hot, at most `most` of them; their keys, as unsigned and in order, and columns."""
    sizes = sorted(((r["n"], r["count"]) for r in rows.groupBy("n").count().collect()), reverse=True)
    total = np.cumsum([c for _, c in sizes])
    fit = int(np.searchsorted(total, most, "right"))
    least = sizes[fit - 1][0] if fit else 1 << 62
    got = rows.where(F.col("n") >= least).select("k", *columns).toArrow()
    k = got["k"].to_numpy().view(_U)
    order = np.argsort(k)
    return least, [k[order], *(got[c].to_numpy().astype(np.float64)[order] for c in columns)]


def train(texts: DataFrame) -> tuple[Automaton, list[DataFrame]]:
    """The automaton of a table of texts (text), and the tables of what it leaves to joins, one of
    words and pairs, one of triples: k, n (of words, else null), v.

    Three passes count words, pairs and triples of the whole corpus; each count is added up
    in tasks before it is shuffled.  A triple can occur twice only if both its pairs do, and a
    pair only if both its words do.
    """
    spark = texts.sparkSession
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"

    def held(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{folder}/{name}")

    def counted(order: int, name: str, grams_of: Callable[[pa.Array], Grams], least: int, about: int) -> tuple[DataFrame, Filter | None]:
        parts = max(3, min(30, int(about // RANGE).bit_length()))
        size = min(BITS, max(parts + 3, int(8 * about).bit_length()))
        size = size if parts <= PARTS and size - parts >= 3 else 0
        found = held(texts.mapInArrow(_deal(grams_of, parts), _DEALT).groupBy("range").applyInArrow(_counted(least, size, parts), _COUNTED), name)
        bits = np.zeros((1 << parts, 1 << max(0, size - parts - 3)), np.uint8)
        if size:
            for r in found.where("bits is not null").select("part", "bits").collect():
                bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        found = found.where("k is not null").select("k", "h", "t", "n")
        return found if order == 1 else found.mapInArrow(_ended(order), "k bigint, h bigint, t bigint, n bigint"), Filter(bits.ravel(), size, parts) if size else None

    def single(t: pa.Array) -> Grams:
        h = tokens(t)[0]
        return Grams(h, h, h, h, np.zeros(len(h), bool))

    about = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts, kept = counted(1, "words", single, 1, about // 6)
    n, v, n1, n2 = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    n = n or 0
    discount = float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5
    word_least, (hot, number) = _hot(counts.where("n >= 2"), HOT, "n")
    # Where all words that occur twice are hot, no other has to be looked for.
    a = Automaton(n, v, discount, Table(hot), number, len(hot) == v - n1, kept)

    def grams(order: int) -> tuple[DataFrame, Filter | None]:
        sent = sc.broadcast(a)

        def grams_of(t: pa.Array) -> Grams:
            h, doc, _ = tokens(t)
            return _grams(sent.value, h, doc, order)[order - 1]

        found = counted(order, f"order-{order}", grams_of, 2, n)
        sent.destroy()
        return found

    pairs, a.kept_pairs = grams(2)
    triples, a.kept_triples = grams(3)

    # Own mass and mass left over of each history, and the values.  Hot words' are in memory.
    taken = lambda rows: rows.groupBy("h").agg(F.sum(F.col("n") - DISCOUNT).alias("taken"))
    left = F.greatest(1 - F.coalesce(F.col("taken") / F.col("n"), F.lit(0.0)), F.lit(1e-12))
    by_word = held(taken(pairs), "taken")
    of_hot = by_word.where("h >= 0").toArrow()
    hot_taken = np.zeros(len(hot))
    hot_taken[of_hot["h"].to_numpy()] = of_hot["taken"].to_numpy().astype(np.float64)
    hot_left = np.maximum(1 - hot_taken / np.maximum(number, 1), 1e-12)
    spare = discount * v / n / (v + 1) if n else 1.0
    hot_p = np.maximum(number - discount, 0) / max(n, 1) + spare
    a.values = np.log10(hot_p) + np.log10(hot_left)

    code = F.col("k").bitwiseOR(F.lit(-(1 << 63))).alias("k")
    rare = counts.where((F.col("n") >= 2) & (F.col("n") < word_least))
    rare = rare.select(code, "n").join(by_word.where("h < 0").withColumnRenamed("h", "k"), "k", "left")
    rare = held(rare.select("k", "n", left.alias("left"), empty_p(a, F.col("n")).alias("p")), "states")

    facts = sc.broadcast((number, hot_left, hot_p))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n and left of the head and p of the tail; null where they are not hot."""
        for batch in batches:
            h, t = (batch.column(i).to_numpy() for i in (1, 2))
            of = lambda x, at: pa.array(x[np.maximum(at, 0)], mask=at < 0) if len(x) else pa.nulls(len(at), pa.float64())
            number, left, p = facts.value
            yield pa.RecordBatch.from_arrays([*batch.columns, of(number, h), of(left, h), of(p, t)], ["k", "h", "t", "n", "n_h", "left_h", "p_t"])

    known = pairs.mapInArrow(told, "k bigint, h bigint, t bigint, n bigint, n_h double, left_h double, p_t double")
    other = known.where("n_h is null or p_t is null")
    other = other.join(rare.select(F.col("k").alias("h"), F.col("n").alias("n_r"), F.col("left").alias("left_r")), "h", "left").join(rare.select(F.col("k").alias("t"), F.col("p").alias("p_r")), "t", "left")
    other = other.select("k", "n", F.coalesce("n_h", "n_r").alias("n_h"), F.coalesce("left_h", "left_r").alias("left_h"), F.coalesce("p_t", "p_r").alias("p_t"))
    arcs = known.where("n_h is not null and p_t is not null").select("k", "n", "n_h", "left_h", "p_t")
    arcs = arcs.union(other.where("n_h is not null and p_t is not null")) if len(hot) < v - n1 else arcs
    lower = F.col("left_h") * F.col("p_t")
    arcs = arcs.select("k", "n", lower.alias("lower"), ((F.col("n") - DISCOUNT) / F.col("n_h") + lower).alias("p"))
    arcs = arcs.join(taken(triples).withColumnRenamed("h", "k"), "k", "left").select("k", "n", "p", left.alias("left"), (F.log10(F.col("p") / F.col("lower")) + F.log10(left)).alias("v"))
    arcs = held(arcs, "arcs")
    facts.destroy()
    by_h = arcs.select(F.col("k").alias("h"), F.col("n").alias("n_h"), F.col("left").alias("left_h"))
    by_t = arcs.select(F.col("k").alias("t"), F.col("p").alias("p_t"))
    gain = F.log10(1 + (F.col("n") - DISCOUNT) / F.col("n_h") / (F.col("left_h") * F.col("p_t")))
    last = held(triples.join(by_h, "h").join(by_t, "t").select("k", "n", gain.alias("v")), "last")

    pair_least, (keys, a.pair_values) = _hot(arcs, HOT_GRAMS, "v")
    a.pairs = Table(keys)
    triple_least, (keys, a.triple_values) = _hot(last, HOT_GRAMS, "v")
    a.triples = Table(keys)
    for name in ("order-2", "order-3", "taken"):  # read for the last time
        dropped(spark, f"{folder}/{name}")
    nothing = F.lit(None).cast("bigint").alias("n")
    told_by_join = lambda rows, least: rows.where(F.col("n") < least).select("k", nothing, "v")
    words = rare.select("k", "n", F.log10("left").alias("v")).union(counts.where("n = 1").select(code, "n", F.lit(0.0)))
    return a, [words.union(told_by_join(arcs, pair_least)), told_by_join(last, triple_least)]


def empty_p(a: Automaton, c: Column) -> Column:
    """Probability after the empty history of tokens with this count."""
    spare = a.discount * a.v / a.n / (a.v + 1) if a.n else 1.0
    return F.greatest(c - a.discount, F.lit(0.0)) / F.lit(float(max(a.n, 1))) + F.lit(spare)


_OWN = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
_ROWS = "row bigint, k bigint, times bigint, word boolean, own struct<doc_id: bigint, n_tokens: bigint, n_known: bigint, base: double, score: double>"


def _traverse(model, step: int):
    """First, per document a row of what its tokens and hot n-grams bring, whose k is its row's
    number, and a row for each of its other words and pairs, with how often it is there, where
    `word` tells words; in the second step such a row for each of its other triples."""

    def once(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of each document, and their numbers.  Most keys are there once: only the
        others are sorted by document as well."""
        order = np.argsort(key)
        k = key[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        often = same[1:] | same[:-1]
        lone, rest = order[~often], order[often]
        rest = rest[np.lexsort((key[rest], doc[rest]))]
        new = np.ones(len(rest), bool)
        new[1:] = (doc[rest][1:] != doc[rest][:-1]) | (key[rest][1:] != key[rest][:-1])
        at = np.flatnonzero(new)
        every = np.concatenate([lone, rest[at]])
        return doc[every], key[every], np.concatenate([np.ones(len(lone), np.int64), np.diff(np.append(at, len(rest)))])

    names = ["row", "k", "times", "word", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Automaton = model.value
        for batch in batches:
            for start, part in chunks(batch.column(1)):
                h, doc, first = tokens(part)
                docs = len(first) - 1
                code, pairs, triples = _grams(a, h, doc)
                known = code < _TOP
                lp, base = np.zeros(len(h)), np.zeros(len(h))
                wid = code[known].astype(np.int64)
                lp[known] = a.values[wid]
                base[known] = a.base_logp(a.counts[wid])
                rest = [once(doc[~known], code[~known])] if step == 0 else [once(doc[:0], code[:0])]
                for order, (g, hot, values) in enumerate(((pairs, a.pairs, a.pair_values), (triples, a.triples, a.triple_values))):
                    if g is None:
                        continue
                    place, seen = hot.find(g.key)
                    lp[g.at[seen]] += values[place[seen]]
                    if order == step:
                        rest.append(once(doc[g.at[~seen]], g.key[~seen]))
                lo = first[:-1]
                sums = [np.add.reduceat(x, lo) for x in (known.astype(np.int64), base, lp)]  # every document has its end
                rows = batch.column(2).slice(start, docs)
                if step == 0:
                    own = pa.StructArray.from_arrays([batch.column(0).slice(start, docs), pa.array(np.diff(first)), *(pa.array(x) for x in sums)], fields=list(_OWN))
                    yield pa.RecordBatch.from_arrays([rows, rows, pa.array(np.ones(docs, np.int64)), pa.array(np.zeros(docs, bool)), own], names)
                rows = rows.to_numpy()
                d, k, times = (np.concatenate(x) for x in zip(*rest, strict=True))
                if len(k):
                    word = np.arange(len(k)) < len(rest[0][0])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[d]), pa.array(k.view(np.int64)), pa.array(times), pa.array(word), pa.nulls(len(k), _OWN)], names)
        give_back()

    return run


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """log10 probabilities of whole texts: doc_id, n_tokens, n_known, train_tokens,
    base_score, score.

    docs: doc_id, text; the rows where `training` holds are learned from, all are scored; other
    columns are ignored.  Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and
    one end; null and empty texts have the end only.  base_score adds one to each count; score
    is the automaton's, with the rest of its mass shared by all unseen tokens as one.  Without
    training rows both are 0.  A row for each input row; rows equal in doc_id and text have one
    result each.  Long texts are read in whole; a task holds one at a time.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("training"))
    a, tables = train(docs.where("training").select("text"))
    sent = docs.sparkSession.sparkContext.broadcast(a)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    c = F.coalesce("n", F.lit(0))
    word, times = F.col("word"), F.col("times")
    nil = F.lit(0.0)
    other = F.col("own").isNull()

    def summed(step: int, values: DataFrame) -> DataFrame:
        # A document's own row has its own key, so that these rows do not meet in one task.
        rows = keyed.mapInArrow(_traverse(sent, step), _ROWS).join(values, "k", "left")
        return rows.groupBy("row").agg(
            F.max("own.doc_id").alias("doc_id"),
            F.sum("own.n_tokens").alias("n_tokens"),
            F.sum(F.when(other, F.when(word & (c > 0), times).otherwise(0)).otherwise(F.col("own.n_known"))).alias("n_known"),
            F.sum(F.when(other, times * F.when(word, F.log10((c + 1) / F.lit(float(a.n + a.v + 1)))).otherwise(nil)).otherwise(F.col("own.base"))).alias("base_score"),
            F.sum(F.when(other, times * (F.when(word, F.log10(empty_p(a, c))).otherwise(nil) + F.coalesce("v", nil))).otherwise(F.col("own.score"))).alias("score"),
            F.count("own").alias("rows"),
        )

    # One order after the other, so that the shuffles of one are gone before the next.
    parts = [written(summed(step, values)) for step, values in enumerate(tables)]
    out = parts[0].union(parts[1]).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score", "rows")))
    # Rows equal in doc_id and text met in one group: one result each again.
    each = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    out = out.select("*", each.alias("copy"))
    share = lambda name: F.col(name) / F.col("rows")
    return out.select("doc_id", share("n_tokens").cast("bigint").alias("n_tokens"), share("n_known").cast("bigint").alias("n_known"), F.lit(a.n).cast("bigint").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score"))
