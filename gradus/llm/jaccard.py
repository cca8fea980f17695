"""N-gram Jaccard join: all documents whose shingle sets are alike, as components.

Documents with equal sets are one class first.  Classes meet through the rarest tokens
of their sets (the necessary prefix).  Inverted lists are searched for T occurrences by
the DivideSkip plan: short lists are merged on a heap that skips what cannot reach T,
long ones probed by binary search, and documents that reach the required overlap are
links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.allpairs import sketches, words_of
from .common import cut, frugal, small, small_batches
from .components import connected
from .words import add_up, chunks, dealt, mix, shingle_sets

#: Documents of a block: its index, and the queries that search it.
BLOCK = 256
#: Lists of up to so many documents are searched pair by pair; longer ones in blocks.
SHORT = 256
#: Documents that share this part of a set's size in prefix tokens are tried first.
LIKELY = 0.04
#: A shingle in more documents than this is ordered after all rarer ones ...
HOT = 16
#: ... and this many such shingles are known to every task: 12 MB at most.
HOT_KEPT = 1 << 20
#: Shingles that a counting task holds at once.
FLUSH = 2_000_000
#: Postings that a task reads at once, and of one list that it holds.
ROWS, HELD = 1 << 16, 1 << 12


def needed(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m items for 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _facts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest = [], []
            for _, part in chunks(batch.column(1)):
                for s in shingle_sets(part, k):
                    n.append(len(s))
                    digest.append(f"{len(s):x}-{int(s.sum()):016x}{int(mix(s ^ np.uint64(0x5DEECE66D)).sum()):016x}" if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n", "digest"])

    return run


def _sorted_parts(k: int, bits: int):
    """Rows (range, once, more, times): the next 32 bits of shingles, dealt by their first
    `bits`; those that the task met once, and the others with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                for s in shingle_sets(part, k):
                    held.append(s)
                    size += len(s)
                if size > FLUSH:
                    yield dealt(np.concatenate(held), bits, whole=False)
                    held, size = [], 0
        if size:
            yield dealt(np.concatenate(held), bits, whole=False)

    return run


def _counted(least: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = add_up(*(np.concatenate([np.frombuffer(x, "<u4") for x in rows[c]]) for c in ("once", "more", "times")))
        hot = n > least
        return pd.DataFrame({"key": (int(key[0]) << 32) + keys[hot].astype(np.int64), "df": n[hot].astype(np.int64)})

    return run


def _hot_shingles(docs: DataFrame, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles' leading 32 + bits bits, sorted, and their counts.

    All are counted; of those above HOT the HOT_KEPT most frequent, by powers of two,
    are returned.  They only order shingles, so that the bound costs time, not links.
    """
    counts = cut(docs.select("text").mapInArrow(frugal(_sorted_parts(k, bits)), "range int, once binary, more binary, times binary").groupBy("range").applyInPandas(_counted(HOT), "key bigint, df bigint"))
    least, held = 0, 0
    for power, n in counts.groupBy(F.floor(F.log2("df")).cast("int").alias("p")).count().orderBy(F.desc("p")).collect():
        held += n
        if held > HOT_KEPT:
            least = 2 ** (power + 1)
            break
    hot = counts.where(F.col("df") >= least).toPandas().sort_values("key")
    return hot["key"].to_numpy(np.uint64), hot["df"].to_numpy(np.uint32)


def _prefixes(k: int, bits: int, percent: int, hot):
    """(node, text, copies) to rows (token, node, n, pos, copies, hot): the rarest tokens of a
    set, rarest first, of which two linked sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, df = hot.value
        for batch in batches:
            ids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for start, part in chunks(batch.column(1)):
                tokens, rows, sizes, places, flags = [], [], [], [], []
                sets = shingle_sets(part, k)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                if len(keys):
                    short = every >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    seen = np.where(keys[at] == short, df[at], 0)
                else:
                    seen = np.zeros(len(every), np.uint32)
                lo = 0
                for i, s in enumerate(sets):
                    n, d = len(s), seen[lo : lo + len(s)]
                    lo += n
                    if not n:
                        continue
                    p = n - -(-percent * n // 100) + 1
                    cold = np.flatnonzero(d == 0)
                    if len(cold) >= p:
                        pick = cold[:p]
                    else:
                        warm = np.flatnonzero(d)
                        pick = np.concatenate([cold, warm[np.argsort(d[warm], kind="stable")][: p - len(cold)]])
                    tokens.append(s[pick])
                    flags.append(d[pick] > 0)
                    rows.append(np.full(p, start + i))
                    sizes.append(np.full(p, n, np.int64))
                    places.append(np.arange(p))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(ids[r := np.concatenate(rows)]), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(copies[r]), pa.array(np.concatenate(flags))], _POSTING)

    return run


_POSTING = ["token", "node", "n", "pos", "copies", "hot"]
_LISTED = "token bigint, node bigint, n bigint, pos bigint, copies bigint, list bigint, centre bigint, rank bigint, centre_n bigint"


def member_hash(node: np.ndarray) -> np.ndarray:
    return mix(node.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by token to those of lists with two members or more.

    `list` is a hash of the members, so that lists with equal members are one; its centre is
    the member with most copies, the smallest of those.  Postings of hot tokens are dealt over
    tasks, and those of very long lists are not held: they come without a list.
    """

    def numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]

    def out(columns: list[np.ndarray], more: list[np.ndarray] | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        found = [pa.array(c) for c in more] if more else [pa.nulls(n, pa.int64())] * 4
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:5]] + found, [x.split()[0] for x in _LISTED.split(", ")])

    def grouped(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole lists."""
        first = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
        size = np.diff(np.append(first, len(columns[0])))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return
        columns, size = [c[keep] for c in columns], size[size > 1]
        first, group = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        _, node, n, _, copies, _ = columns
        name = np.add.reduceat(member_hash(node), first) ^ mix(size.astype(np.uint64))
        centre = np.lexsort((node, -copies, group))[first]
        yield out(columns, [x[group] for x in (name.view(np.int64), node[centre], copies[centre], n[centre])])

    held = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
    over = None  # the token whose list is too long to hold
    waiting: list[pa.RecordBatch] = []

    def step(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, over
        columns = [np.concatenate(x) for x in zip(held, *map(numbers, waiting), strict=True)]
        waiting.clear()
        apart = columns[5] | (columns[0] == over if over is not None else False)
        if apart.any():
            yield out([c[apart] for c in columns])
            columns = [c[~apart] for c in columns]
        if not len(columns[0]):
            held = columns
            return
        at = len(columns[0]) if last else int(np.searchsorted(columns[0], columns[0][-1]))
        if at:
            yield from grouped([c[:at] for c in columns])
        held = [c[at:] for c in columns]
        if len(held[0]) > HELD:
            over = held[0][0]
            yield out(held)
            held = [c[:0] for c in held]

    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size > ROWS:
            yield from step(False)
            size = 0
    yield from step(True)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in chunks(batch.column(1)):
                sets = shingle_sets(part, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])

    return run


def merged(lists: list[list[int]], weights: list[int], least: int) -> tuple[list[int], list[int]]:
    """What ascending lists of a total weight of at least `least` hold, and that weight.

    A heap has the next item of each list.  Where the lists at the least item weigh too little,
    further lists are taken off while they all do: what these hold before the heap's next item
    cannot reach `least`, and is skipped by binary search.
    """
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapify(heap)
    at = [0] * len(lists)
    items, totals = [], []
    while heap:
        item, taken, weight = heap[0][0], [], 0
        while heap and heap[0][0] == item:
            i = heappop(heap)[1]
            taken.append(i)
            weight += weights[i]
        if weight >= least:
            items.append(item)
            totals.append(weight)
            upto = item + 1
        else:
            while heap and weight + weights[heap[0][1]] < least:
                i = heappop(heap)[1]
                taken.append(i)
                weight += weights[i]
            if not heap:
                break
            upto = heap[0][0]
        for i in taken:
            at[i] = bisect_left(lists[i], upto, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))
    return items, totals


class Index:
    """Inverted lists of a block of sets, for T-occurrence search; equal lists are one, with the
    number of their items as weight."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")  # so that the owners in a list ascend
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        self.items = every[first]
        name = np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), first) if len(every) else every
        _, some, self.list = np.unique(name, return_index=True, return_inverse=True)
        last = np.append(first[1:], len(every))
        self.lists = [owner[first[i] : last[i]] for i in some.tolist()]
        self.length = np.array([len(x) for x in self.lists], np.int64)

    def search(self, q: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the sets that link with q, by DivideSkip.

        T is the least overlap any set of the block could need.  The longest of q's lists, L
        by weight, are set aside; sets in at least T - L of the short ones are probed for in
        the long ones, and stay if they reach the overlap that their own size asks for.
        """
        none = np.zeros(0, np.int64)
        if not len(q) or not len(self.items):
            return none
        fits = (100 * self.sizes >= percent * len(q)) & (percent * self.sizes <= 100 * len(q))
        if not fits.any():
            return none
        t = needed(len(q), int(self.sizes[fits].min()), percent)
        at = np.minimum(np.searchsorted(self.items, q), len(self.items) - 1)
        mine, weight = np.unique(self.list[at[self.items[at] == q]], return_counts=True)
        if weight.sum() < t:
            return none
        order = np.argsort(-self.length[mine], kind="stable")
        mine, weight = mine[order], weight[order]
        longest = int(self.length[mine[0]])
        aside = min(t - 1, int(t / (0.01 * np.log2(longest + 1) * longest + 1)))
        far = int(np.searchsorted(np.cumsum(weight), aside, "right"))
        least = t - int(weight[:far].sum())
        found, count = (np.array(x, np.int64) for x in merged([self.lists[i].tolist() for i in mine[far:].tolist()], weight[far:].tolist(), least))
        keep = fits[found]
        found, count = found[keep], count[keep]
        for i, w in zip(mine[:far].tolist(), weight[:far].tolist(), strict=True):
            owners = self.lists[i]
            p = np.minimum(np.searchsorted(owners, found), len(owners) - 1)
            count += w * (owners[p] == found)
        return found[100 * count >= percent * (len(q) + self.sizes[found] - count)]


def admitted(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """A row for each set of a: which sets of b it may link with, by sizes and by sketches, in which
    each item flips a bit: sets have at least as many differing items as bits."""
    n, m = (np.array([len(s) for s in sets], np.int64) for sets in (a, b))
    words = int(words_of(np.array([max(n.max(initial=1), m.max(initial=1))]))[0])
    x, y = (sketches(np.concatenate([np.zeros(0, np.uint64), *sets]), size, words) for sets, size in ((a, n), (b, m)))
    differing = np.zeros((len(a), len(b)), np.uint16)
    for w in range(words):
        differing += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    n, m, differing = n[:, None], m[None], differing.astype(np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * differing <= (100 - percent) * (n + m))


def _search_block(percent: int):
    """Links between a block's queries and its index, but for those inside one component.  Only
    queries that a sketch admits to another component's set search the lists."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "items"])
        index, queries = rows[rows["indexed"]], rows[~rows["indexed"]]
        nodes = index["node"].tolist()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        sets, asking = ([np.frombuffer(x, np.uint64) for x in r["items"]] for r in (index, queries))
        may, found = admitted(asking, sets, percent), None
        comp = index["comp"].tolist()
        links = []
        for k, (node, c) in enumerate(queries[["node", "comp"]].itertuples(index=False)):
            mine = root(c)
            if all(root(comp[i]) == mine for i in np.flatnonzero(may[k]).tolist()):
                continue
            found = found or Index(sets)
            for i in found.search(asking[k], percent).tolist():
                theirs = root(comp[i])
                if theirs != mine:
                    links.append((node, nodes[i]))
                    parent[max(mine, theirs)] = min(mine, theirs)
                    mine = min(mine, theirs)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _verify(percent: int):
    """Rows (a, b, x, y) whose sets x and y link: each a searches the lists of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            order = np.lexsort((b, a))
            keep = np.zeros(len(a), bool)
            for rows in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
                found = Index([np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64) for i in rows.tolist()])
                keep[rows[found.search(np.frombuffer(batch.column(2)[int(rows[0])].as_buffer(), np.uint64), percent)]] = True
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _room(n: str, m: str, percent: int):
    """Least overlap of linked sets of n and m items, less what lies beyond the prefixes."""
    beyond = F.ceil(percent * F.greatest(n, m) / 100) - 1
    return F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent)) - beyond


def components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents under 100 * |A & B| >= percent * |A | B| of shingle sets.

    docs: doc_id bigint, text string; other columns are ignored.  Returns a row for each
    input row: doc_id, n_shingles (size of its set of distinct k-word shingles over words
    `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased) and component_id, the smallest doc_id
    that links reach.

    Null, empty and blank texts have no shingles, link with nothing and are their own
    component.  Texts of fewer than k words have one shingle.  Rows that share a doc_id are
    one node.  A row whose doc_id is null gets the component of rows with an equal set, or
    null.  No rows give no rows.  Shingles are 64-bit hashes.
    """
    docs = small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    facts = cut(docs.mapInArrow(frugal(_facts(k)), "doc_id bigint, n bigint, digest string"))
    classes = facts.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    total = facts.agg(F.sum("n")).first()[0] or 0
    bits = max(5, min(24, int(total // 1_000_000).bit_length()))
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(_hot_shingles(docs, k, bits))

    # Postings of the classes' first documents only: copies are taken out where they are read.
    # A doc_id that is first in any class stays.
    shared = cut(classes.where("copies > 1 and node is not null"))
    firsts = shared.groupBy("node").agg(F.max("copies").alias("copies"))
    mine = facts.where("n > 0 and doc_id is not null").join(shared.select("digest", "node"), "digest", "left")
    roles = mine.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("doc_id") != F.col("node"), F.lit(False))).alias("copy"))
    roles = roles.where("copy").select("doc_id", F.lit(0).cast("bigint").alias("copies")).union(firsts.select(F.col("node").alias("doc_id"), "copies"))
    roles = small(cut(roles.groupBy("doc_id").agg(F.max("copies").alias("copies"))))
    readers = docs.where("doc_id is not null").join(roles, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    postings = readers.select("doc_id", "text", "copies").mapInArrow(frugal(_prefixes(k, bits, percent, hot)), "token bigint, node bigint, n bigint, pos bigint, copies bigint, hot boolean")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // 8_000_000))
    # Rows of frequent shingles are dealt apart: they need not meet, as others have them for sure.
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(1009))).otherwise(0)
    postings = postings.repartition(parts, "token", salt).sortWithinPartitions("token")
    postings = cut(postings.mapInArrow(_listed, _LISTED))

    # The lists of frequent shingles, of which few reach a prefix, are added up over tasks.
    dealt = postings.where("list is null").select("token", "node", "n", "pos", "copies")
    facts_of = dealt.groupBy("token").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node", "n").cast("decimal(20,0)")).alias("sum"), F.max(F.struct("copies", (-F.col("node")).alias("minus"), "n")).alias("c"))
    facts_of = cut(facts_of.where("size > 1").select("token", F.xxhash64("size", "sum").alias("list"), (-F.col("c.minus")).alias("centre"), F.col("c.copies").alias("rank"), F.col("c.n").alias("centre_n")))
    dealt = dealt.join(small(facts_of), "token")
    columns = ["list", "node", "n", "pos", "centre", "rank", "centre_n"]
    every = postings.where("list is not null").select(columns).union(dealt.select(columns))
    # Of lists with equal members one is kept, in which a node has the rarest of its places.
    members = cut(every.groupBy("list", "node", "n").agg(F.count("*").alias("tokens"), F.min("pos").alias("pos"), *(F.max(c).alias(c) for c in ("centre", "rank", "centre_n"))))

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = small(cut(wanted.toDF("doc_id").distinct()))
        return docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(frugal(_sets(k)), "node bigint, items binary")

    # First each node and the centre with which it shares most tokens, if sizes admit it:
    # groups of near copies join here, and what does not is left to the search below.
    near = members.where((F.col("node") != F.col("centre")) & (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")))
    near = near.groupBy("node", "n", "centre", "rank").agg(F.sum("tokens").alias("shared")).where(F.col("shared") > LIKELY * F.col("n"))
    stars = near.groupBy("node").agg(F.max(F.struct("shared", "rank", (-F.col("centre")).alias("minus"))).alias("c")).select(F.col("node").alias("a"), (-F.col("c.minus")).alias("b"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        with_x = pairs.join(sets_of(pairs.select("a")).select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        with_y = with_x.join(sets_of(pairs.select("b")).select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        return with_y.select("a", "b", "x", "y").mapInArrow(frugal(_verify(percent)), "a bigint, b bigint")

    first = cut(connected(linked(stars)))

    # Then the lists that still hold several components ...
    placed = members.join(first, "node", "left").select("list", "node", "tokens", "pos", "n", F.coalesce("component", "node").alias("comp"))
    open_lists = placed.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("list", "size")
    placed = cut(placed.join(open_lists, "list"))

    # ... pairs across components in short lists.  Two sets whose first common token is in one
    # share at most: what short lists show, what both have in long ones (all of them later in the
    # order), and what lies beyond the prefix of one.
    long_tokens = cut(placed.where(F.col("size") > SHORT).groupBy("node").agg(F.sum("tokens").alias("more")))
    brief = placed.where(F.col("size") <= SHORT).join(small(long_tokens), "node", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    other = brief.select("list", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "pos", "comp", "more")))
    later = (F.col("n_") > F.col("n")) | (F.col("n_") == F.col("n")) & (F.col("node_") > F.col("node"))
    pairs = brief.join(other, "list").where((F.col("comp") != F.col("comp_")) & later & (percent * F.col("n_") <= 100 * F.col("n")))
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("node_").alias("b"), "n", "n_").agg(F.sum("tokens").alias("shared"), *(F.min(c).alias(c) for c in ("pos", "pos_", "more", "more_")))
    # All that two sets share lies at or after their first common token, by rarity.
    after = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_")) >= percent * (F.col("n") + F.col("n_"))
    enough = F.col("shared") + F.least("more", "more_") >= _room("n", "n_", percent)
    more = linked(pairs.where(after & enough).select("a", "b").distinct())

    # ... and blocks of index and queries in long ones.  The list's most frequent component
    # asks no queries, and is in the index only: any other pair has a member that asks.
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    placed = placed.where(F.col("size") > SHORT).withColumn("class", F.floor(F.log("n") / step + 1e-9))
    main = placed.groupBy("list", "comp").agg(F.count("*").alias("c")).groupBy("list").agg(F.max(F.struct("c", "comp")).alias("m")).select("list", F.col("m.comp").alias("main"))
    queries = placed.join(main, "list").where("comp <> main")
    blocks = placed.groupBy("list", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("n").alias("least"), F.max("n").alias("most"))
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A query meets documents of its own class and the two next to it on either side, since the
    # ratio of sizes is at most one class's, and bounds are rounded.
    queries = queries.withColumn("class", F.explode(F.array([F.col("class") + i for i in range(-2, 3)])))
    queries = queries.join(blocks, ["list", "class"]).where((percent * F.col("n") <= 100 * F.col("most")) & (percent * F.col("least") <= 100 * F.col("n")))
    queries = cut(queries.select("list", "class", "node", "n", "comp", "blocks"))
    parts = queries.groupBy("list", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("one"), F.max("comp").alias("two"))
    # What no query of the list could link with stays out of the index.
    fits = (100 * F.col("n") >= percent * F.col("lo")) & (percent * F.col("n") <= 100 * F.col("hi"))
    fits = fits & ((F.col("one") != F.col("two")) | (F.col("comp") != F.col("one")))
    queries = queries.join(parts, ["list", "class"]).select("list", "class", "node", "comp", each("blocks").alias("block"), spread("parts").alias("part"), F.lit(False).alias("indexed"))
    indexed = placed.join(blocks.join(parts, ["list", "class"]), ["list", "class"]).where(fits).select("list", "class", "node", "comp", spread("blocks").alias("block"), each("parts").alias("part"), F.lit(True).alias("indexed"))
    rows = cut(queries.union(indexed))
    rows = rows.join(sets_of(rows.select("node")), "node")
    more = more.union(rows.groupBy("list", "class", "block", "part").applyInPandas(_search_block(percent), "a bigint, b bigint"))
    label = first.select("node", "component")
    more = more.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    second = connected(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    named = classes.join(first, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("c"))
    named = named.join(second.select(F.col("node").alias("c"), "component"), "c", "left").select("digest", F.coalesce("component", "c").alias("component"))
    # Rows without shingles, and rows whose doc_id names another class's node, keep to their own id.
    return facts.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
