"""Vectorised word and shingle hashing over Arrow string columns.

Texts are handled as the UTF-8 bytes that Arrow already holds: one pass of numpy
array operations finds the words of many documents at once, so no Python object is
made per word.  Callers feed record batches; `chunks` cuts them into pieces of about
`CHUNK_BYTES`, which bounds the memory of a task however long a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64 steps), so that all bits depend on all."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """What `mix` made these of."""
    h = h.astype(_U, copy=True)
    h ^= (h >> _U(31)) ^ (h >> _U(62))
    h *= _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    h ^= (h >> _U(27)) ^ (h >> _U(54))
    h *= _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    h ^= (h >> _U(30)) ^ (h >> _U(60))
    return h


class Table:
    """Sorted 64-bit hashes, found through their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length())
        self._shift = _U(64 - bits)
        first = np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << self._shift).astype(np.int32)
        self._first = np.append(first, np.int32(len(keys)))

    def __getstate__(self) -> np.ndarray:  # what is sent to tasks: the rest is made there
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.__init__(keys)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each wanted hash, and whether it is there; -1 where it is not."""
        top = (wanted >> self._shift).astype(np.int64)
        at, end = self._first[top], self._first[top + 1]
        out = np.full(len(wanted), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            found = self.keys[here] == wanted[todo]
            out[todo[found]] = here[found]
            todo = todo[~found]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out, out >= 0


def in_ranges(keys: np.ndarray, shift: int) -> tuple[list[int], list[int]]:
    """The ranges, keys >> shift, of sorted keys, and where each begins; with the end."""
    ranges = keys >> _U(shift)
    first = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return ranges[first].astype(np.int64).tolist(), [*first.tolist(), len(keys)]


def dealt(keys: np.ndarray, bits: int, whole: bool = True) -> pa.RecordBatch:
    """Hashes by their leading `bits`: rows (range, once, more, times) of those that are here
    once, and of the others with their numbers.  If not `whole`, only the next 32 bits are kept."""
    k, n = np.unique(keys if whole else keys >> _U(32 - bits), return_counts=True)
    rows: list[tuple] = []
    for single in (True, False):
        some = (n == 1) == single
        part, times = k[some], n[some].astype("<u4")
        ranges, at = in_ranges(part, 64 - bits if whole else 32)
        part = part if whole else (part & _U(0xFFFFFFFF)).astype("<u4")
        for r, lo, hi in zip(ranges, at[:-1], at[1:], strict=True):
            v = part[lo:hi].tobytes()
            rows.append((r, v, b"", b"") if single else (r, b"", v, times[lo:hi].tobytes()))
    r, once, more, times = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), *(pa.array(x, pa.binary()) for x in (once, more, times))], ["range", "once", "more", "times"])


def add_up(once: np.ndarray, more: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a range and their numbers, from what `dealt` made of several parts."""
    keys, n = np.unique(once, return_counts=True)
    repeated, which = np.unique(more, return_inverse=True)
    if not len(repeated):
        return keys, n
    total = np.bincount(which, times, len(repeated)).astype(np.int64)
    at = np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)
    both = repeated[at] == keys
    total[at[both]] += n[both]
    return np.concatenate([keys[~both], repeated]), np.concatenate([n[~both], total])


#: One random value per byte, so that the polynomial is not over small numbers.
_VALUE = mix(np.arange(1, 257, dtype=_U) * _BASE)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = {"n": 0}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least `n` of each."""
    if _powers["n"] < n:
        n = max(n, 2 * CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(n, base, dtype=_U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
        _powers["n"] = n
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a chunk of documents, in text order.

    hash: uint64 per word; doc: index of its document in the chunk; first: for each
    document the index of its first word, with the total appended.
    """

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices (start row, texts) of at most `limit` bytes, or one longer document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    sizes = np.nan_to_num(texts.is_valid().to_numpy(zero_copy_only=False).astype(np.int64) * _lengths(texts))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield start, texts.slice(start, i - start)
            start, held = i, 0
        held += n
    yield start, texts.slice(start)


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(_offsets(texts))


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if texts.buffers()[1] is None:
        return np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chunk's texts one after the other, and the n + 1 bounds; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    off = _offsets(texts)
    data = texts.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return b, off - off[0]


def word_bounds(b: np.ndarray, off: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run without separators inside one document."""
    n = len(b)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~apart[b]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = off[1:-1]
    inner = inner[inner < n]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner[inner > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(texts: pa.Array, apart: np.ndarray = SPACE) -> Words:
    """Words of one chunk: lower-cased A-Z, hashed to 64 bits.

    Equal words have equal hashes in every task and run; different words share one
    with a chance of about n * n / 2**65 for n distinct words.
    """
    b, off = text_bytes(texts)
    b = LOWER[b]
    starts, ends = word_bounds(b, off, apart)
    if len(starts) == 0:
        return Words(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    up, down = _pow(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum(_VALUE[b] * up[: len(b)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(h, doc, first)


def ngrams(w: Words, n: int) -> np.ndarray:
    """Hash of the n words that begin at each position; only positions whose n words lie
    in one document mean anything (`w.doc[i] == w.doc[i + n - 1]`)."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    h = np.zeros(m, dtype=_U)
    for i in range(n):
        h *= _U(0xD6E8FEB86659FD93)
        h += w.hash[i : i + m]
    return mix(h + _U(n))


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles.

    A document of fewer words, but not none, has one shingle of all its words; one
    without words, or null, has none.
    """
    w = words(texts)
    g = ngrams(w, k)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = hi - lo
        if n >= k:
            s = np.sort(g[lo : hi - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif n:
            part = Words(w.hash[lo:hi], w.doc[lo:hi], np.array([0, n]))
            out.append(ngrams(part, n))
        else:
            out.append(np.zeros(0, _U))
    return out
