"""Benchmark decontamination as a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, small

#: All but digits, lower-case letters and what is not ASCII; applied after lower-casing.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle, the token of the join; a shorter window is one shingle.
SHINGLE = 3
#: Windows that may be broadcast: texts of some ten words, 20 MB or so.
WINDOWS = 200_000


def item_words(c: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(c, F.lit(""))), APART), lambda w: w != "")


def windows(items: DataFrame, n: int) -> DataFrame:
    """Windows of n words of the items: item (item_id as a string), window (words joined by a
    space), length.  Shorter items are one window, empty ones none."""
    w = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).where("size(w) > 0")
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    w = w.select("item", F.explode(F.transform(at, lambda i: F.slice(F.col("w"), i + 1, n))).alias("w"))
    return w.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("length")).distinct()


def _shingles(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """Rows (*keep, pos, hash) of the shingles of `sizes` words of an array column w."""
    n = F.size("w")
    words = [f"w{j}" for j in range(max(sizes))]
    zipped = F.arrays_zip(*((F.col("w") if j == 0 else F.slice("w", F.lit(j + 1), n)).alias(c) for j, c in enumerate(words)))
    each = rows.select(*keep, n.alias("of"), F.posexplode(zipped).alias("pos", "z"))
    hashed = lambda s: F.struct(F.lit(s).alias("s"), F.xxhash64(*(F.col(f"z.{c}") for c in words[:s])).alias("hash"))
    if len(sizes) == 1:
        each = each.select(*keep, "of", "pos", hashed(sizes[0]).alias("h"))
    else:
        each = each.select(*keep, "of", "pos", F.explode(F.array(*(hashed(s) for s in sizes))).alias("h"))
    return each.where("pos + h.s <= of").select(*keep, "pos", "h.hash")


def _hits(docs: DataFrame, windowed: DataFrame) -> DataFrame:
    """Occurrences of windows: row (a hash of doc_id and text), doc_id, start, length, window.

    docs: doc_id, text.  All shingles of a window must be there, so that one is its necessary
    prefix: the one that documents have least often.  Its place in both gives the only possible
    start, which must leave room for the window's length, and the words there are compared.
    """
    texts = windowed.select("window", "length").distinct()
    sizes = sorted(r[0] for r in texts.select(F.least("length", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    of_size = [_shingles(texts.where(F.least("length", F.lit(SHINGLE)) == s).select("window", "length", F.split("window", " ").alias("w")), [s], "window", "length") for s in sizes]
    parts = of_size[0]
    for more in of_size[1:]:
        parts = parts.union(more)
    parts = cut(parts)
    words = docs.select(F.xxhash64("doc_id", "text").alias("row"), item_words(F.col("text")).alias("w"))
    words = words.select("row", "w", F.size("w").alias("n_words"))
    found = cut(_shingles(words, sizes, "row", "n_words").join(small(parts.select("hash").distinct()), "hash"))
    seen = found.groupBy("hash").agg(F.count("*").alias("n"))
    # A window with a shingle that no document has cannot occur.
    prefix = parts.join(seen, "hash", "left").groupBy("window", "length").agg(F.min(F.struct("n", "hash", F.col("pos").alias("offset"))).alias("p"), F.count_if(F.col("n").isNull()).alias("missing"))
    prefix = cut(prefix.where("missing = 0").select("length", "p.hash", "p.offset").distinct())
    near = found.join(small(prefix), "hash").where("pos >= offset and pos - offset + length <= n_words")
    near = near.select("row", (F.col("pos") - F.col("offset")).alias("start"), "length").distinct()
    near = cut(near.groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("near")))
    held = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).join(small(near.select("row")), "row", "left_semi").dropDuplicates(["row"])
    said = held.join(near, "row").select("row", "doc_id", item_words(F.col("text")).alias("w"), "near")
    # The words are bound once a row: else the text is split for each place.
    there = lambda w: F.transform("near", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"), F.array_join(F.slice(w, h["start"] + 1, h["length"]), " ").alias("window")))
    said = said.select("row", "doc_id", F.inline(F.get(F.transform(F.array("w"), there), 0)))
    return said.join(small(cut(texts.select("window")), WINDOWS), "window")


def occurrences(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id of documents with an occurrence of some item's window, as in `contamination`."""
    return _hits(docs.select("doc_id", "text"), windows(items, n)).select("doc_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Words of each document that lie in a whole occurrence of an item's window.

    docs: doc_id, text; items: item_id, text; other columns are ignored.  Returns a row for
    each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Windows are found as `_hits` says; each row has the result of its own text, rows without
    doc_id and rows that share one too.  Null and empty texts have no words; items without
    words have no windows; no items leave every document clean.  Items that share a window all
    count; items without item_id are a window, but no item.  Texts are read whole.
    """
    docs = docs.select("doc_id", "text")
    windowed = windows(items, n)
    hits = cut(_hits(docs, windowed))
    places = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"))
    covered = F.expr(
        """aggregate(hits, named_struct('n', 0L, 'upto', 0L), (a, h) -> named_struct(
             'n', a.n + greatest(0L, h.start + h.length - greatest(a.upto, cast(h.start as bigint))),
             'upto', greatest(a.upto, cast(h.start + h.length as bigint))), a -> a.n)"""
    )
    ids = hits.select("row", "window").distinct().join(windowed.select("window", "item"), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    hit = small(cut(places.select("row", covered.alias("n_hit")).join(ids, "row", "left")), WINDOWS)
    out = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.size(item_words(F.col("text"))).cast("bigint").alias("n_words")).join(hit, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
