"""Secret scans over a content-addressed ledger of blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
MATCHES = "array<struct<gap:bigint,own:bigint,n:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` count if `group` has `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base kinds.  Maximal runs need no retry, so that their least
#: length stands in the pattern: the same matches, found without visiting short runs.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def matches(text: Column, rule: Rule) -> Column:
    """Matches of a rule in order, as (gap, own, n): characters since the last match, of the match,
    and of the group.  Spark gives matches and the pieces between them; each is found once."""
    pattern = F.lit(rule.pattern)
    every = F.array(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"), F.split(text, rule.pattern, -1).alias("p")))
    size = lambda c: F.char_length(c).cast("bigint")
    each = lambda e: F.transform(e["m"], lambda m, i: F.struct(size(F.get(e["p"], i)).alias("gap"), size(m).alias("own"), size(F.get(e["g"], i)).alias("n")))
    return F.when(text.rlike(rule.pattern), F.get(F.transform(every, each), F.lit(0))).otherwise(F.array().cast(MATCHES))


def placed(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (`FOUND`) of rows (blob, kind, version, matches): starts are the running sums of
    what stands before.  A text's matches are rows, and their places are summed by a window."""
    m = found.select("blob", "kind", "version", F.posexplode("matches").alias("at", "m"))
    own = Window.partitionBy("blob", "kind", "version").orderBy("at")
    m = m.withColumn("end", F.sum(F.col("m.gap") + F.col("m.own")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.coalesce(*(F.when(F.col("kind") == r.kind, r.least) for r in rules))
    rank = F.coalesce(*(F.when(F.col("kind") == r.kind, i) for i, r in enumerate(rules)))
    span = F.struct((F.col("end") - F.col("m.own")).alias("start"), rank.alias("rank"), "kind", "end")
    return m.where(F.col("m.n") >= least).groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(span)).alias("found"))


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id and blob, the SHA-256 of the text (null: empty): which path holds which blob."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def _row() -> Column:
    """128 bits that stand for doc_id and text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit("row"), "doc_id", "text").alias("b"))


FOUND = f"blob string, kind string, version int, found {SPANS}"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the blobs of `docs` that `ledger` (blob, kind, version) lacks for a rule's version.

    docs: doc_id, text; several texts of a doc_id are its versions, each a blob.  Each content
    is read once, however many paths hold it.  Returns the triples that are new to the ledger
    (blob, kind, version), and the findings in them (`FOUND`, a row for each triple with any).
    Append both to what earlier runs kept.  Null texts are the empty blob; no rows give none.
    """
    held = blobs(docs)
    kinds = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    fresh = held.select("blob").distinct().select("blob", F.inline(kinds))
    rows = docs.select(_row().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # Copies of a content are left out where they are read; rows that repeat its first path are
    # read once more.
    named = docs.select(_row().alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    first = named.groupBy("blob").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = small(cut(named.join(small(cut(first), 200_000), "blob").where("row <> first").select("row").distinct()))
    unseen = rows.join(copies, "row", "left_anti").select(F.sha2("text", 256).alias("blob"), "text")
    if ledger is not None:
        fresh = cut(fresh.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti"))
        unseen = unseen.join(small(cut(fresh.groupBy("blob").agg(F.collect_set("kind").alias("kinds"))), 100_000), "blob")
    text = F.col("text")
    none = F.array().cast(MATCHES)
    wanted = lambda r: F.lit(True) if ledger is None else F.array_contains("kinds", r.kind)
    each = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(wanted(r), matches(text, r)).otherwise(none).alias("matches")) for r in rules))
    found = unseen.where(F.greatest(*(text.rlike(r.pattern) for r in rules))).select("blob", F.inline(each)).where("size(matches) > 0")
    return fresh, placed(found.dropDuplicates(["blob", "kind", "version"]), rules)


class Ledger:
    """What earlier scans read and found, as two tables in a folder that executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._seen, self._found = spark, f"{folder}/seen", f"{folder}/found"

    def _table(self, path: str, schema: str) -> DataFrame:
        """The table, empty if nothing was written."""
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
        return self._spark.read.schema(schema).parquet(path) if there else self._spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._table(self._seen, "blob string, kind string, version int")

    def found(self) -> DataFrame:
        return self._table(self._found, FOUND)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new, and return all findings so far.

        Findings are written before the ledger names their blobs: after a failure between, they
        are found again, and `findings` takes one of equal ones.
        """
        fresh, found = scan(docs, rules, self.seen())
        fresh = cut(fresh)
        found.write.mode("append").parquet(self._found)
        fresh.write.mode("append").parquet(self._seen)
        return self.found()


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, found: DataFrame | None = None) -> DataFrame:
    """Findings of every path: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    docs: doc_id, text; other columns are ignored.  `found` (`FOUND`) is what scans of all of
    docs kept; without it they are scanned here.  Only findings of the rules' own versions
    count: those of older ones are replaced.  A row for each input row; null texts are empty;
    copies share what one scan of their content found; texts without findings have zero counts
    and the SHA-256 of the empty string.
    """
    found = scan(docs, rules)[1] if found is None else found
    now = F.greatest(F.lit(False), *((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules))
    found = found.where(now).dropDuplicates(["blob", "kind", "version"]).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    out = blobs(docs).join(small(cut(found), 100_000), "blob", "left").select("doc_id", F.coalesce("found", F.array().cast(SPANS)).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
