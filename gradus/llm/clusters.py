"""Centroid clustering by exponion search, exact in whole numbers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shared_dir, small_batches, written

#: Components are under this, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27
#: What bounds give way by, relatively: far over the rounding of a square root and some sums.
SLACK = 1e-12

STATE = "vec_id bigint, v array<int>, cluster int, upper double, lower double, distance bigint"


def whole(vectors: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component x, of vectors that can be clustered.

    vectors: vec_id, embedding; other columns are ignored.  Vectors that are null, have not
    exactly `size` components, or have a null or non-finite one are left out.  Components at or
    over LARGEST after scaling end the query with an error, as their distances fit no long.
    Rows that repeat a vec_id, null too, are vectors of their own.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    kept = vectors.select("vec_id", x.alias("x")).where((F.size("x") == size) & F.forall("x", lambda e: F.coalesce(finite(e), F.lit(False))))
    scaled = F.transform("x", lambda e: F.floor(e * scale))
    large = F.exists("x", lambda e: F.abs(e * scale) >= LARGEST)
    return kept.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component reaches {LARGEST} / {scale}"))).otherwise(scaled.cast("array<int>")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (all, if fewer) with the smallest SHA-256 of seed:vec_id, in that order; null
    ids hash as empty ones, and rows that repeat an id go by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to c (one centroid, or one for each row)."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Ball:
    """Centroids, and for each the others in order of distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        d = np.sqrt(np.stack([squares(centroids, x) for x in centroids]).astype(float)) * (1 - SLACK)
        np.fill_diagonal(d, -1.0)  # each comes first in its own list
        self.order = np.argsort(d, axis=1, kind="stable")
        self.dist = np.take_along_axis(d, self.order, axis=1)
        self.gap = self.dist[:, 1].copy() if len(centroids) > 1 else np.full(1, np.inf)

    def search(self, v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Put vectors with centroids `a` and bounds to their nearest centroids, in place.

        A vector whose upper bound on the distance to its own centroid is under the lower bound
        to all others, or under half the gap to the next centroid, stays.  Others scan the ball
        of radius 2 * upper + gap around their centroid, which holds their nearest and second
        nearest; the radius is inclusive and the bounds give way, so that equal distances are
        seen and the smaller number wins.  Returns how many distances were computed.
        """
        near = lambda rows: np.flatnonzero(~(upper[rows] < np.maximum(lower[rows], self.gap[a[rows]] / 2)))
        rows = near(slice(None))
        done = len(rows)
        upper[rows] = np.sqrt(squares(v[rows], self.c[a[rows]]).astype(float)) * (1 + SLACK)
        rows = rows[near(rows)]
        for i in np.unique(a[rows]):
            own = rows[a[rows] == i]
            wide = np.searchsorted(self.dist[i], (2 * upper[own] + self.gap[i]) * (1 + SLACK), side="right")
            by_width = np.argsort(-wide, kind="stable")
            own, wide = own[by_width], wide[by_width]
            x = v[own]
            best, second, to = (np.full(len(own), np.iinfo(np.int64).max) for _ in range(3))
            for t in range(wide[0]):
                n = np.searchsorted(-wide, -t, side="left")  # those whose ball has more than t
                j = self.order[i, t]
                d = squares(x[:n], self.c[j])
                done += n
                b, s = best[:n], second[:n]
                wins = (d < b) | ((d == b) & (j < to[:n]))
                s[:] = np.where(wins, b, np.minimum(s, d))
                to[:n][wins] = j
                b[wins] = d[wins]
            a[own] = to
            upper[own] = np.sqrt(best.astype(float)) * (1 + SLACK)
            lower[own] = np.where(second < np.iinfo(np.int64).max, np.sqrt(second.astype(float)) * (1 - SLACK), np.inf)
        return done


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first assignment, without bounds: number, upper and lower bound of each row."""
    d = np.stack([squares(v, x) for x in c], axis=1)
    a = d.argmin(axis=1)
    two = np.sort(d, axis=1)[:, :2].astype(float)
    lower = np.sqrt(two[:, 1]) * (1 - SLACK) if len(c) > 1 else np.full(len(v), np.inf)
    return a, np.sqrt(two[:, 0]) * (1 + SLACK), lower


def assigning(centroids: np.ndarray, before: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches of STATE: bounds follow the centroids from `before`, then the search."""
    moved = None if before is None else np.sqrt(squares(centroids, before).astype(float)) * (1 + SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(centroids)
        if moved is not None:
            far = np.argsort(-moved, kind="stable")
            others = np.where(np.arange(len(moved)) == far[0], moved[far[1]] if len(far) > 1 else 0.0, moved[far[0]])
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            if moved is None:
                a, upper, lower = nearest(v, centroids)
            else:
                a = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = (b.column("upper").to_numpy(zero_copy_only=False) + moved[a]) * (1 + SLACK)
                held = b.column("lower").to_numpy(zero_copy_only=False)
                lower = np.where(np.isinf(held), held, held - others[a] - SLACK * (np.abs(held) + others[a]))
                ball.search(v, a, upper, lower)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(a.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(squares(v, centroids[a]))], ["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Cluster vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors: as in `whole`.  Centroids start as `first_centroids`; each round assigns every vector
    to the nearest one (squared distance, ties to the smaller number) and replaces each that has
    vectors by the floor of their exact mean; then all are assigned once more.  With fewer than k
    vectors each is a centroid; equal ones leave the larger numbers empty.  An empty table gives
    none.

    A vector carries its centroid and bounds from round to round in a table in the shared
    folder, so that a lost executor costs its tasks of one round; the table before it goes.  The
    driver holds k centroids and their sums, never vectors.
    """
    spark = vectors.sparkSession
    size = 64
    folder = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    state = written(whole(vectors, size), f"{folder}/0")
    centroids, before = first_centroids(state, k, seed), None
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for r in range(rounds + 1):
        state = written(small_batches(state).mapInArrow(assigning(centroids, before), STATE), f"{folder}/{r + 1}")
        dropped(spark, f"{folder}/{r}")
        if r == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(size))).collect()
        before, centroids = centroids, centroids.copy()
        for s in sums:
            centroids[s.cluster] = [s[f"s{i}"] // s.n for i in range(size)]
    inertia = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    about = [(i, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, d in inertia.items()]
    of = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster")

