"""Line dedup, filter audit and centroid clustering against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from messy import docs
from pyspark.sql import functions as F

from gradus.llm import audit, clusters, linededup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def lined(spark):
    """Texts of lines that few or many documents hold, in other cases and with other blanks."""
    rng = random.Random(4)
    shared = [f"Shared line number {i} that is quite long é enough" for i in range(12)]
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, shared[0]), (3, shared[0]), (None, shared[0] + "\nx"), (None, shared[1])]
    for i in range(60):
        own = [rng.choice(shared[: rng.randrange(1, 13)]) for _ in range(rng.randrange(0, 5))] + [f"own line {i} " * 5, "short", "", "y" * 39, " " + "y" * 38 + " \t", "Z" * 40]
        own = [rng.choice((x, x.upper(), "\t" + x + " \r")) for x in own]
        rng.shuffle(own)
        rows.append((10 + i * 7, "\n".join(own)))
    rows.append((5000, "\n".join(f"a long line that stands alone in this text {j}" for j in range(20000)) + "\n" + shared[2]))
    rows.append(rows[20])
    return docs(spark, rows), rows


def line_key(line):
    return line.strip(BLANK).translate(LOWER)


def brute_lines(rows, least=5):
    held, last = Counter(), {}
    for i, t in rows:
        for k in {line_key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held[k] += 1
                last[k] = max([x for x in (last.get(k), i) if x is not None], default=None)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if held[line_key(x)] < least or last[line_key(x)] == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_line_dedup(spark, batches):
    d, rows = lined(spark)
    got = linededup.dedup(d, batches=batches)
    assert Counter(map(tuple, got.collect())) == brute_lines(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_line_dedup_shuffled_and_empty(spark, monkeypatch):
    d, rows = lined(spark)
    monkeypatch.setattr(linededup, "small", lambda df: df)
    assert Counter(map(tuple, linededup.dedup(d).collect())) == brute_lines(rows)
    assert linededup.dedup(d.limit(0)).count() == 0


def test_line_runs(spark):
    """Batches one by one: what is new to the runs, levels, and totals over them."""
    runs = linededup.LineRuns(spark, buckets=4)
    rng = random.Random(8)
    seen, total, last = set(), Counter(), {}
    for b in range(7):
        held = {rng.randrange(60): (rng.randrange(1, 4), rng.randrange(1000)) for _ in range(25)}
        batch = spark.createDataFrame([(k, -k, n, at) for k, (n, at) in held.items()], "h1 bigint, h2 bigint, n bigint, last bigint")
        new = {r.h1 for r in runs.fresh(batch).collect()}
        runs.add(batch)
        assert new == set(held) - seen
        seen |= set(held)
        for k, (n, at) in held.items():
            total[k] += n
            last[k] = max(last.get(k, at), at)
        assert [len(level) for level in runs._known][: 3] == [int(c) for c in f"{b + 1:b}"[::-1]][: 3]
    got = {r.h1: r.last for r in runs.frequent(5).collect()}
    assert got == {k: last[k] for k, n in total.items() if n >= 5}
    runs.close()


def test_runs_merge_without_a_shuffle(spark):
    runs = linededup.LineRuns(spark, buckets=4)
    rows = spark.range(1000).selectExpr("id AS h1", "id AS h2", "1L AS n", "id AS last")
    a, b = runs.stored(rows), runs.stored(rows.where("id < 500"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    try:
        anti = shown(spark.table(a).join(spark.table(b), linededup.HASH, "left_anti"))
        plans = [anti, shown(runs._merged(a, b))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs.close()
    assert all("SortMergeJoin" in p and "Exchange" not in p for p in plans)


def brute_audit(rows, labels):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(lambda: [0] * 6)
    lost = Counter()
    for i, source, t in rows:
        t, part = t or "", source or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                here = fails[f] and not gone
                c = out[part, order, step]
                c[2] += fails[f] and gone
                gone |= here
                c[0] += not gone
                c[1] += here
                c[3] += fails[f] and sum(fails.values()) == 1
                c[4] += here and i in good
                c[5] += here and i in toxic
                lost[part, f] += here
    return {(*k, *v, lost[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, monkeypatch):
    d = docs(spark)
    rows = [(r.doc_id, r.source, r.text) for r in d.select("doc_id", "source", "text").collect()]
    labels = [(i * 3, (0, 1, None)[i % 3], (0, 0, 0, 1)[i % 4]) for i in range(0, 60, 2)] + [(9, 1, 0), (9, 0, None), (None, 1, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in labels], "doc_id bigint, quality int, toxic int, part string, first int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = brute_audit(rows, labels)
    got = audit.replay(audit.failures(d, table))
    assert sorted(got.columns) == sorted(names)
    found = [tuple(r) for r in got.select(names).collect()]
    assert len(found) == len(want) and set(found) == want
    assert {r[0] for r in found} == {"", "s1", "s2"} and len(found) == 3 * 120 * 5
    assert audit.replay(audit.failures(d, table.limit(0))).count() == len(found)
    assert audit.replay(audit.failures(d.limit(0), table)).count() == 0
    monkeypatch.setattr(audit, "small", lambda df: df)
    assert {tuple(r) for r in audit.replay(audit.failures(d, table)).select(names).collect()} == want


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2.0) for i, e in rows], "vec_id bigint, embedding array<float>, label int, v string, upper double").repartition(3)


def brute_clusters(rows, k, rounds=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = np.array([v for _, v in start], object)
    x = np.array([v for _, v in kept], object)
    put = lambda: [min((int(((v - c[j]) ** 2).sum()), j) for j in range(len(c))) for v in x]
    for _ in range(rounds):
        to = put()
        for j in range(len(c)):
            own = [v for v, (_, i) in zip(x, to) if i == j]
            if own:
                c[j] = sum(own) // len(own)
    to = put()
    sha = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return Counter((i, j, d, sum(e for e, m in to if m == j), sum(e for e, _ in to), sha(j)) for (i, _), (d, j) in zip(kept, to))


def embeddings(n, seed, spread):
    """Vectors with ties: few values, equal vectors, mirrored ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        e = [rng.randrange(-spread, spread + 1) / 256 if j < 6 else 0.0 for j in range(64)]
        rows.append((i, e))
        if i % 11 == 0:
            rows.append((i, list(e)))
        if i % 13 == 0:
            rows.append((i + 10**6, [-x for x in e]))
    return rows


@pytest.mark.parametrize("n, k, spread", [(300, 40, 2), (200, 7, 1), (150, 40, 400), (9, 40, 3), (1, 40, 1), (30, 1, 5)])
def test_clusters(spark, n, k, spread):
    rows = embeddings(n, n + k, spread)
    rows += [(None, rows[0][1]), (7, None), (8, [0.5] * 63), (8, [0.5] * 65), (9, []), (9, [None] + [0.1] * 63), (9, [float("nan")] + [0.1] * 63), (9, [float("-inf")] + [0.1] * 63)]
    got = clusters.cluster(vectors(spark, rows), k=k)
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == brute_clusters(rows, k)


def test_clusters_of_none_and_too_large(spark):
    got = clusters.cluster(vectors(spark, [(1, [0.0] * 63)]))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    large = vectors(spark, [(1, [1e30] + [0.0] * 63), (2, [0.0] * 64)])
    with pytest.raises(Exception, match="a component reaches"):
        clusters.cluster(large).collect()


def test_search_scans_a_ball():
    """Tight groups: later rounds compute few of all distances, and the same numbers."""
    rng = np.random.default_rng(2)
    c = rng.integers(-4000, 4000, (40, 64))
    v = c[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64))
    a, upper, lower = clusters.nearest(v, c)
    moved = c + rng.integers(-5, 5, c.shape)
    p = np.sqrt(((moved - c) ** 2).sum(axis=1)) * 1.001
    want = clusters.nearest(v, moved)[0]
    done = clusters.Ball(moved).search(v, a, upper + p[a], lower - p.max())
    assert (a == want).all() and done < 3000 * 40 / 20
    rough = np.full(3000, np.inf)
    done = clusters.Ball(moved).search(v, a, rough, np.zeros(3000))
    assert (a == want).all() and done < 3000 * 40


def test_written_state_has_bounds(spark, monkeypatch):
    kept = []
    real = clusters.written
    monkeypatch.setattr(clusters, "written", lambda df, path: kept.append(real(df, path)) or kept[-1])
    monkeypatch.setattr(clusters, "dropped", lambda *a: None)
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=64)]) for i in range(80)]
    clusters.cluster(vectors(spark, rows), k=5).collect()
    assert len(kept) == 7
    for state in kept[1:]:
        assert state.where((F.col("upper") * F.col("upper") < F.col("distance") * 0.999999) | (F.col("lower") < 0) & F.lit(False)).count() == 0
