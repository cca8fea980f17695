"""All pairs of texts that are alike, on their terms: one chunk of texts after the other goes to all
tasks, and each text is compared with it where it is read.

Nothing is written for a pair that only might be alike.  A block of texts and a range of the chunk
are compared by a bound that no wanted pair exceeds, on arrays; what is left is counted exactly.

For a Jaccard index the bound is a sketch: each term flips a bit, so that two texts have at least as
many differing terms as bits.  Sketches have more words for larger texts; the wider of two is folded.
For a cosine it is a product of unit vectors: terms fall into BINS, and a bin holds the norm of
what is in it, by Cauchy's inequality; first of their projections on DIMS directions, with what both
leave out as if it were parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

#: Terms of a sketch's word of 64 bits, at most, and words, both by powers of two.
TERMS, WORDS = 40, 512
#: Numbers of a text's vector, and of its projection, for a cosine.
BINS, DIMS = 1024, 128
#: Texts of a block, and those of the chunk that it meets at once.
ROWS, TILE = 128, 4096
#: A subject with so many texts has directions of its own, from up to so many texts.
FIT, FITTED = 256, 2048
#: Pairs that leave a task at once, at least, and terms that are counted at once.
EMIT, TERMS_AT_ONCE = 1 << 16, 1 << 20
#: More than any rounding of a bound.
SLACK = 1e-4

MET = "left_id bigint, right_id bigint, left_size int, right_size int, left_norm2 bigint, right_norm2 bigint, common bigint, dot bigint"
_MET = [x.split()[0] for x in MET.split(", ")]


_PACKED = StructType([StructField("signature", BinaryType()), StructField("keys", BinaryType()), StructField("tfs", BinaryType()), StructField("size", IntegerType()), StructField("norm2", LongType())])


@F.arrow_udf(_PACKED)
def packed(tokens: pa.Array) -> pa.Array:
    """Hashes of a text's tokens to distinct ones in order, their numbers (of one, two or four bytes
    each), a signature of both, how many there are, and the sum of squared numbers."""
    values, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
    signatures, keys, tfs, sizes, norms = [], [], [], [], []
    for i in range(len(tokens)):
        key, tf = np.unique(values[at[i] : at[i + 1]], return_counts=True)
        most = int(tf.max(initial=0))
        keys.append(key.tobytes())
        tfs.append(tf.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes())
        signatures.append(blake2b(keys[-1] + tfs[-1], digest_size=16).digest())
        sizes.append(len(key))
        norms.append(int((tf * tf).sum()))
    columns = [pa.array(signatures, pa.binary()), pa.array(keys, pa.binary()), pa.array(tfs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(norms, pa.int64())]
    return pa.StructArray.from_arrays(columns, _PACKED.names)


class Texts:
    """Rows (id, subject, size, norm2, keys, tfs, same) as arrays, by subject and size; `same`: whether
    the row is in the chunk that it meets, so that a pair comes twice."""

    def __init__(self, rows: pa.Table):
        subject, size = (rows.column(c).to_numpy() for c in ("subject", "size"))
        order = np.lexsort((size, subject))
        self.subject, self.size = subject[order], size[order].astype(np.int64)
        self.id, self.norm2, self.same = (rows.column(c).to_numpy()[order] for c in ("id", "norm2", "same"))
        keys, tfs = rows.column("keys"), rows.column("tfs")
        self.keys = np.frombuffer(b"".join(keys[i].as_buffer() for i in order.tolist()), np.int64)
        parts = [np.frombuffer(tfs[i].as_buffer(), f"<u{len(tfs[i].as_buffer()) // n}") for i, n in zip(order.tolist(), self.size.tolist(), strict=True)]
        self.tfs = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        first = np.flatnonzero(np.concatenate(([True], self.subject[1:] != self.subject[:-1]))) if len(self.id) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(self.id))
        #: Where a subject's texts are.
        self.places = {int(self.subject[a]): (int(a), int(b)) for a, b in zip(first, ends)}


def words_of(size: np.ndarray) -> np.ndarray:
    """Words of a sketch, by the text's size."""
    return np.minimum(WORDS, 1 << np.ceil(np.log2(np.maximum(1, size / TERMS))).astype(np.int64))


def sketches(keys: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """The words of texts' sketches, from their keys one text after the other."""
    out = np.zeros(len(sizes) * words, np.uint64)
    k = keys.view(np.uint64)
    place = (k >> np.uint64(6)) & np.uint64(words - 1)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(sizes)) * words, sizes) + place.astype(np.int64), np.uint64(1) << (k & np.uint64(63)))
    return out.reshape(len(sizes), words)


def folded(s: np.ndarray, words: int) -> np.ndarray:
    while s.shape[1] > words:
        s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
    return s


def binned(keys: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, norm2: np.ndarray) -> np.ndarray:
    """Unit vectors: the norm of what falls into each bin."""
    k = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    bins = np.repeat(np.arange(len(sizes)) * BINS, sizes) + (k % np.uint64(BINS)).astype(np.int64)
    x = np.bincount(bins, tfs.astype(np.float64) ** 2, len(sizes) * BINS).reshape(len(sizes), BINS)
    return np.sqrt(x / np.maximum(1, norm2)[:, None]).astype(np.float32)


def directions(texts: Texts) -> dict[int, np.ndarray]:
    """For each subject with texts enough, orthonormal directions that hold much of its vectors.
    Any directions give a right bound; these only make it a close one."""
    out = {}
    for subject, (a, b) in texts.places.items():
        if b - a >= FIT:
            some = np.unique(np.linspace(a, b - 1, min(b - a, FITTED)).astype(np.int64))
            x = np.concatenate([binned(texts.keys[(s := slice(texts.at[i], texts.at[i + 1]))], texts.tfs[s], texts.size[i : i + 1], texts.norm2[i : i + 1]) for i in some])
            out[subject] = np.linalg.eigh(x.T @ x)[1][:, -DIMS:].astype(np.float32)
    return out


def projected(x: np.ndarray, to: np.ndarray | None) -> np.ndarray:
    """Vectors whose products are no less than those of x: coordinates and the norm of the rest, or
    without directions the norms of bins put together."""
    if to is None:
        return np.sqrt((x * x).reshape(len(x), DIMS, -1).sum(2))
    p = x @ to
    return np.hstack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1, keepdims=True)) + 1e-5)])


class Chunk:
    """What all tasks get: a chunk's texts, their keys as places in its vocabulary."""

    def __init__(self, texts: Texts, to: dict[int, np.ndarray]):
        self.texts, self.to = texts, to
        self.vocabulary, term = np.unique(texts.keys, return_inverse=True)
        self.term = term.astype(np.int32)


class Search:
    """A chunk as a task searches it, for a least cosine, Jaccard index, or both."""

    def __init__(self, chunk: Chunk, cosine: float | None, jaccard: float | None):
        self.chunk, self.t, self.cosine, self.jaccard = chunk, chunk.texts, cosine or 0.0, jaccard
        self.numbers = np.zeros(len(chunk.vocabulary), np.int64)
        self.made: dict = {}

    def _once(self, key, make):
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def _sketch(self, a: int, b: int, own: int, words: int) -> np.ndarray:
        """Sketches of the chunk's texts from a to b, folded, a row a word."""
        t = self.t
        return self._once((a, b, words), lambda: np.ascontiguousarray(folded(sketches(t.keys[t.at[a] : t.at[b]], t.size[a:b], own), words).T))

    def _vectors(self, subject: int) -> tuple[np.ndarray, np.ndarray]:
        t, (a, b) = self.t, self.t.places[subject]

        def make():
            x = np.concatenate([binned(t.keys[t.at[i] : t.at[j := min(i + TILE, b)]], t.tfs[t.at[i] : t.at[j]], t.size[i:j], t.norm2[i:j]) for i in range(a, b, TILE)])
            return x, projected(x, self.chunk.to.get(subject))

        return self._once(subject, make)

    def _by_sketches(self, p: Texts, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text of p from i to j, text of the chunk) whose sizes and sketches admit the index."""
        t, (a, b), least = self.t, self.t.places[int(p.subject[i])], self.jaccard - 1e-6
        part = (1 - least) / (1 + least)
        own = int(words_of(p.size[i : i + 1])[0])
        mine = sketches(p.keys[p.at[i] : p.at[j]], p.size[i:j], own)
        wide = self._once(("words", a), lambda: words_of(t.size[a:b]))
        lo, hi = a + int(np.searchsorted(t.size[a:b], least * p.size[i])), a + int(np.searchsorted(t.size[a:b], p.size[j - 1] / least, "right"))
        for words in np.unique(wide[lo - a : hi - a]).tolist():
            first, last = a + int(np.searchsorted(wide, words)), a + int(np.searchsorted(wide, words, "right"))
            both = min(words, own)
            theirs, ours = self._sketch(first, last, words, both), folded(mine, both)
            for at in range(max(lo, first), min(hi, last), TILE):
                to = min(at + TILE, hi, last)
                differing = np.zeros((j - i, to - at), np.uint16)
                for w in range(both):
                    differing += np.bitwise_count(ours[:, w, None] ^ theirs[w, None, at - first : to - first])
                most = (p.size[i:j] * (part + 1e-6) + 1e-2).astype(np.float32)[:, None] + (t.size[at:to] * (part + 1e-6)).astype(np.float32)[None]
                r, c = np.nonzero(differing <= most)
                s, m = p.size[i + r], t.size[at + c]
                fits = np.minimum(s, m) >= least * np.maximum(s, m)
                yield i + r[fits], at + c[fits]

    def _by_vectors(self, p: Texts, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text of p from i to j, text of the chunk) whose vectors admit the cosine."""
        subject = int(p.subject[i])
        (a, b), (x, short) = self.t.places[subject], self._vectors(subject)
        own = binned(p.keys[p.at[i] : p.at[j]], p.tfs[p.at[i] : p.at[j]], p.size[i:j], p.norm2[i:j])
        mine, least = projected(own, self.chunk.to.get(subject)), self.cosine - SLACK
        for at in range(0, b - a, TILE):
            near = mine @ short[at : at + TILE].T >= least
            if near.sum() * 8 > near.size:
                near &= own @ x[at : at + TILE].T >= least
                r, c = np.nonzero(near)
                yield i + r, a + at + c
                continue
            r, c = np.nonzero(near)
            for k in range(0, len(r), TILE):
                u, v = r[k : k + TILE], c[k : k + TILE]
                good = np.einsum("ij,ij->i", own[u], x[at + v]) >= least
                yield i + u[good], a + at + v[good]

    def _counted(self, p: Texts, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common terms of pairs, by text of p, and the sums of the products of their numbers."""
        t, vocabulary, numbers = self.t, self.chunk.vocabulary, self.numbers
        common, dot = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        starts = np.append(np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))), len(r))
        for k, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            s = slice(p.at[r[k]], p.at[r[k] + 1])
            term = np.minimum(np.searchsorted(vocabulary, p.keys[s]), len(vocabulary) - 1)
            known = vocabulary[term] == p.keys[s]
            term = term[known]
            numbers[term] = p.tfs[s][known]
            while k < end:
                n = np.cumsum(t.size[c[k:end]])
                to = k + max(1, int(np.searchsorted(n, TERMS_AT_ONCE, "right")))
                size, n = t.size[c[k:to]], n[: to - k]
                at = np.repeat(t.at[c[k:to]] - (n - size), size) + np.arange(n[-1])
                both = numbers[self.chunk.term[at]]
                common[k:to] = np.add.reduceat(both > 0, n - size, dtype=np.int64)
                dot[k:to] = np.add.reduceat(both * t.tfs[at], n - size)
                k = to
            numbers[term] = 0
        return common, dot

    def met(self, p: Texts) -> Iterator[list[np.ndarray]]:
        """Columns of MET for the pairs of p's texts and the chunk's that are wanted, but for rounding."""
        t, by = self.t, self._by_sketches if self.jaccard is not None else self._by_vectors
        for subject, (a, b) in p.places.items():
            if subject not in t.places:
                continue
            edges = [a, b] if self.jaccard is None else [a, *(a + 1 + np.flatnonzero(np.diff(words_of(p.size[a:b])))).tolist(), b]
            blocks = [(i, min(i + ROWS, to)) for fr, to in zip(edges, edges[1:]) for i in range(fr, to, ROWS)]
            for i, j in blocks:
                for r, c in by(p, i, j):
                    new = (p.id[r] != t.id[c]) & (~p.same[r] | (p.id[r] > t.id[c]))
                    r, c = r[new], c[new]
                    if not len(r):
                        continue
                    common, dot = self._counted(p, r, c)
                    size, other, norm2, norm2_of = p.size[r], t.size[c], p.norm2[r], t.norm2[c]
                    good = common > 0
                    if self.jaccard is not None:
                        good &= common >= (self.jaccard - 1e-6) * (size + other - common)
                    good &= dot >= (self.cosine - 1e-6) * np.sqrt(norm2.astype(np.float64) * norm2_of)
                    first = p.id[r] < t.id[c]
                    pick = lambda x, y: (np.where(first, x, y)[good], np.where(first, y, x)[good])
                    yield [*pick(p.id[r], t.id[c]), *pick(size, other), *pick(norm2, norm2_of), common[good], dot[good]]


_held: list = [None, None]


def _search(chunk, cosine: float | None, jaccard: float | None) -> Search:
    """One search a worker: what it makes of a chunk serves the worker's later tasks too."""
    if _held[0] is not chunk:
        _held[:] = None, None
        _held[:] = chunk, Search(chunk.value, cosine, jaccard)
    return _held[1]


def searched(chunk, cosine: float | None, jaccard: float | None):
    """For `mapInArrow` over rows of `Texts` with `same`: their pairs with a broadcast Chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            for columns in _search(chunk, cosine, jaccard).met(Texts(pa.Table.from_batches([batch]))):
                waiting.append(columns)
                n += len(columns[0])
                if n >= EMIT:
                    yield _rows(waiting)
                    waiting, n = [], 0
        if n:
            yield _rows(waiting)

    return run


def _rows(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*parts), kinds)], _MET)
