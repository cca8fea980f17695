"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, small, space_words

#: Hashes that a fingerprint keeps.  A likeness is off by about sqrt(p * (1 - p) / K).
K = 96
SHINGLE = 5


def sketched(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add `name`, the sorted k smallest distinct 64-bit shingle hashes of column `text`.

    A text of fewer words, but not none, is one shingle; null and blank texts have an empty
    sketch.  Long texts first drop hashes that are too large to be among the k smallest, and
    only sort what is left; where that leaves fewer than k, all are sorted.
    """
    w, s = f"__{name}_w", f"__{name}_s"
    df = df.withColumn(w, F.transform(space_words(lower_ascii(F.col(text))), lambda x: F.xxhash64(x)))
    at = F.sequence(F.lit(0), F.size(w) - shingle)
    each = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(shingle))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(s, F.when(F.size(w) >= shingle, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none))
    limit = F.when(F.size(s) > 4 * k, F.lit(-(2.0**63)) + 2.0**64 * 3 * k / F.size(s)).otherwise(2.0**63).cast("bigint")
    low = f"__{name}_l"
    df = df.withColumn(f"{low}m", limit).withColumn(low, F.array_distinct(F.filter(s, lambda h: h <= F.col(f"{low}m"))))
    least = lambda c: F.slice(F.sort_array(c), 1, k)
    df = df.withColumn(name, F.when(F.size(low) >= k, least(F.col(low))).otherwise(least(F.array_distinct(s))))
    return df.drop(w, s, low, f"{low}m")


def merged(sketches: list[Column], k: int = K) -> Column:
    """The sketch of the union of the sets whose sketches these are."""
    return F.slice(F.sort_array(reduce(F.array_union, sketches)), 1, k)


def combined(parts: DataFrame, by: str, sketch: str, k: int = K) -> DataFrame:
    """`by` and `sketch` of whole texts or groups from the sketches of their parts.

    Each task keeps the k smallest hashes of a group before they are shuffled, so that a group of
    any size costs k rows a task.  Groups whose parts have no shingles have an empty sketch; a
    null `by` is a group.
    """
    each = parts.select(by, F.explode(sketch).alias("__h")).distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy("__h"))
    least = each.withColumn("__n", place).where(F.col("__n") <= k).groupBy(by).agg(F.array_sort(F.collect_list("__h")).alias(sketch))
    keys = parts.select(F.struct(by).alias("__key")).distinct()
    out = keys.join(least.select(F.struct(by).alias("__key2"), sketch), F.col("__key").eqNullSafe(F.col("__key2")), "left")
    return out.select(F.col(f"__key.{by}").alias(by), F.coalesce(sketch, F.array().cast("array<bigint>")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A & B| / |A | B|, exact for sets of up to k; two empty sets are alike."""
    union = merged([a, b], k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact for up to k - 1."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A & B| / |A|; an empty A is contained."""
    shared = resemblance(a, b, k) * distinct(merged([a, b], k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def successors(docs: DataFrame, rows: int = 100_000) -> DataFrame:
    """id, n_chars and next_id of each distinct doc_id in ascending order, null first; the
    last one's next is the first.  Ranges of ids are ordered apart, and then joined by their
    first ids, so that no task orders all."""
    ids = docs.select(F.struct("doc_id").alias("id"), F.char_length("text").alias("n")).groupBy("id").agg(F.max("n").alias("n_chars"))
    n = docs.select("doc_id").count()
    ranged = cut(ids.repartitionByRange(max(1, n // rows), "id").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))
    everything = Window.partitionBy(F.lit(0))
    after = F.coalesce(F.lead("first").over(everything.orderBy("part")), F.min("first").over(everything))
    firsts = firsts.select("part", after.alias("after"))
    inner = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return ranged.withColumn("inner", inner).join(firsts, "part").select("id", "n_chars", F.coalesce("inner", "after").alias("next_id"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of texts and of their edited texts: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_distinct, in_edited (the share of
    the text's shingles that the edited text has).

    docs: doc_id, text; other columns are ignored; whole texts are read.  In the edited text the last floor(n_chars / 4) code points are the
    first as many of the next document's text (by doc_id; after the last comes the first).
    Null texts are empty.  Of rows that share a doc_id, the next document is that of the next id;
    where that has several texts, the one with the smallest SHA-256 stands for it.  Each row has
    its own result, by its own length.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chain = small(cut(successors(docs)).select(F.col("next_id.doc_id").alias("next"), F.col("id.doc_id").alias("target"), F.floor(F.col("n_chars") / 4).cast("int").alias("need")))
    heads = docs.join(chain, F.col("doc_id").eqNullSafe(F.col("next"))).select("target", F.substring("text", F.lit(1), F.col("need")).alias("head"), "text")
    heads = sketched(heads.withColumn("digest", F.sha2("text", 256)), "text", "sketch", k).select("target", "digest", "head", "sketch")
    heads = heads.groupBy("target").agg(F.min(F.struct("digest", "head", "sketch")).alias("next"))
    out = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("target")))
    out = out.select("doc_id", "text", F.char_length("text").cast("bigint").alias("n_chars"), F.col("next.head").alias("head"), F.col("next.sketch").alias("next_sketch"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - moved)
    out = out.withColumn("edited", F.concat(kept, F.substring("head", F.lit(1), moved)))
    out = sketched(sketched(out, "text", "sketch", k), "edited", "edited_sketch", k)
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct(F.col("sketch"), k).alias("n_distinct"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("in_edited"),
    )
