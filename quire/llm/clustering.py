"""Centroid clustering of whole numbers (k-means, a fixed number of rounds), exact, with bounds in heaps.

A vector's gap is its distance to the second nearest centroid less that to its own. When centroids move, the gap of a vector of
cluster c shrinks by at most what c moved and the farthest that any other one moved; the sum of these is c's drift. A block of
vectors keeps, for each cluster, a heap of gaps, each with the drift of the moment it was measured added to it. Gaps that are
at the top and no greater than the drift by now have expired: only these vectors are popped and compared with all centroids
again. All others are sure to stay where they are."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import scratch, staged

#: Components beyond this are taken as it: squared distances of up to 128 components are then sure to fit 64 bits.
MOST = 1 << 27
#: Components up to this give squared distances that floating point holds exactly (up to 128 components).
EXACT = 1 << 22
#: Relative margin for what roots and sums round away.
MARGIN = 1e-12
#: Vectors that share their heaps.
BLOCK = 8192


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(np.clip(values.astype(np.float64) * scale, -MOST, MOST)).astype(np.int64)


def smallest_type(x: np.ndarray) -> np.ndarray:
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32)


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every centroid."""
    most = max(abs(int(m)) for y in (x, centroids) for m in (y.max(initial=0), y.min(initial=0)))
    x, c = (y.astype(np.float64 if most <= EXACT else np.int64) for y in (x, centroids))
    return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)


class Bounds:
    """Clusters of a block's vectors, and for each cluster a heap of (gap + drift when measured, vector)."""

    def __init__(self, assigned: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.assigned, self.heaps = assigned, heaps

    @classmethod
    def new(cls, x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> "Bounds":
        bounds = cls(np.full(len(x), -1, np.int32), [[] for _ in centroids])
        bounds.scan(x, centroids, drift, np.arange(len(x)))
        return bounds

    def scan(self, x: np.ndarray, centroids: np.ndarray, drift: np.ndarray, rows: np.ndarray) -> None:
        """Compare some vectors with all centroids, and measure their gaps."""
        d = squares(x[rows], centroids)
        own = d.argmin(1)  # of equal ones the smallest number
        upper = np.sqrt(d[np.arange(len(rows)), own].astype(np.float64))
        lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) if d.shape[1] > 1 else np.full(len(rows), np.inf)
        key = lower * (1 - MARGIN) - upper * (1 + MARGIN) + drift[own]
        self.assigned[rows] = own
        for k, c, row in zip(key.tolist(), own.tolist(), rows.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (k, row))

    def move(self, x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Assign all vectors to centroids that have moved: the vectors that were scanned for that, and their clusters before."""
        gone = []
        for heap, most in zip(self.heaps, (drift * (1 + MARGIN)).tolist(), strict=True):
            while heap and heap[0][0] <= most:
                gone.append(heapq.heappop(heap)[1])
        rows = np.array(sorted(gone), np.int64)
        before = self.assigned[rows]
        if len(rows):
            self.scan(x, centroids, drift, rows)
        return rows, before

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        flat = [e for h in self.heaps for e in h]
        keys, rows = np.array([k for k, _ in flat], np.float64), np.array([r for _, r in flat], np.int32)
        return self.assigned.tobytes(), np.array([len(h) for h in self.heaps], np.int32).tobytes(), keys.tobytes(), rows.tobytes()

    @classmethod
    def unpacked(cls, assigned: bytes, sizes: bytes, keys: bytes, rows: bytes) -> "Bounds":
        entries = list(zip(np.frombuffer(keys).tolist(), np.frombuffer(rows, np.int32).tolist(), strict=True))
        upto = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        return cls(np.frombuffer(assigned, np.int32).copy(), [entries[a:z] for a, z in zip([0, *upto], upto)])


def changes(x: np.ndarray, rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """What the clusters' counts and sums gain and lose by vectors that change their cluster; before: -1 for none."""
    rows, before, after = (a[before != after] for a in (rows, before, after))
    out = []
    for c in np.unique(np.concatenate([before, after])).tolist():
        if c >= 0:
            gain, loss = x[rows[after == c]], x[rows[before == c]]
            out.append({"cluster": c, "n": len(gain) - len(loss), "sums": (gain.sum(0, dtype=np.int64) - loss.sum(0, dtype=np.int64)).tolist()})
    return out


STATE = ["assigned", "sizes", "keys", "rows"]
CHANGES = "array<struct<cluster:int,n:long,sums:array<long>>>"
CHANGES_ARROW = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def as_blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """ids, data: vectors(id, v) in blocks of whole numbers."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                data = smallest_type(whole(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column("id")]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data.tobytes()], pa.binary()), pa.array([data.itemsize], pa.int32())], names=["ids", "data", "width"])

    return vectors.mapInArrow(build, f"ids array<{dict(vectors.dtypes)['id']}>, data binary, width int")


def matrix_of(b: pa.RecordBatch, k: int, dims: int) -> np.ndarray:
    return np.frombuffer(b.column("data")[k].as_py(), f"<i{b.column('width')[k].as_py()}").reshape(-1, dims)


def assigned_blocks(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks with their bounds after one assignment, what changed, and how many vectors were scanned. Blocks without bounds
    are scanned whole."""
    dims = centroids.shape[1]
    fresh = "assigned" not in blocks.columns
    names = ["ids", "data", "width", *STATE, "changes", "scanned"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = matrix_of(b, k, dims)
                if fresh:
                    bounds, rows = Bounds.new(x, centroids, drift), np.arange(len(x))
                    before = np.full(len(x), -1, np.int32)
                else:
                    bounds = Bounds.unpacked(*(b.column(c)[k].as_py() for c in STATE))
                    rows, before = bounds.move(x, centroids, drift)
                made = [pa.array([v], pa.binary()) for v in bounds.packed()]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in names[:3]), *made, pa.array([changes(x, rows, before, bounds.assigned[rows])], CHANGES_ARROW), pa.array([len(rows)], pa.int64())], names=names)

    kept = blocks.select("ids", "data", "width", *([] if fresh else STATE))
    return kept.mapInArrow(assign, f"ids {dict(blocks.dtypes)['ids']}, data binary, width int, {', '.join(f'{c} binary' for c in STATE)}, changes {CHANGES}, scanned long")


def settled(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance of every vector of assigned blocks."""
    dims, kind = centroids.shape[1], dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x, own = matrix_of(b, k, dims).astype(np.int64), np.frombuffer(b.column("assigned")[k].as_py(), np.int32)
                distance = ((x - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(k, 1).flatten(), pa.array(own), pa.array(distance)], names=["id", "cluster", "distance"])

    return blocks.select("ids", "data", "width", "assigned").mapInArrow(rows, f"id {kind}, cluster int, distance long")


def moved(blocks: DataFrame, centroids: np.ndarray, n: list[int], sums: list[list[int]]) -> np.ndarray:
    """The centroids after a round: floor(sum / count) where there are vectors. n, sums: of the round before, brought up to date;
    a row for each cluster and component comes to the driver."""
    gains = blocks.select(F.inline("changes")).select("cluster", "n", F.posexplode("sums"))
    for r in gains.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("sum")).collect():
        sums[r["cluster"]][r["pos"]] += r["sum"]
        n[r["cluster"]] += r["n"] if r["pos"] == 0 else 0
    return np.array([[s // k for s in row] if k else c for row, k, c in zip(sums, n, centroids.tolist(), strict=True)], np.int64)


def drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each cluster's drift after a move: what it moved itself, and the farthest that another one moved."""
    steps = [math.sqrt(sum(int(x) ** 2 for x in row)) * (1 + MARGIN) for row in new - old]
    other = [max(steps[:c] + steps[c + 1 :], default=0.0) for c in range(len(steps))]
    return drift + np.array(steps) + np.array(other)


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has `dims` components, none null or non-finite; never null."""
    x = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce((F.size(vector) == dims) & F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster (int), distance (long, squared), cluster_inertia, inertia (long), centroid_sha256 of every usable() vector.

    Components become floor(scale * x). Centroids start as the k vectors with the smallest sha256 of `seed`:id (ties: by the
    vector itself), in that order; each round assigns all vectors to the nearest centroid (ties: smaller number) and moves
    centroids to the floor of their vectors' mean; empty ones stay. At the end vectors are assigned once more.

    Vectors travel once, into blocks of BLOCK; a round reads and writes blocks with their heaps and moves nothing between
    tasks but each block's change of the clusters' sums. Null ids are hashed as the empty word; every row is a vector of its own,
    also if its id or its vector is repeated. Fewer than k vectors give as many clusters; none, no rows. Components beyond MOST
    are taken as MOST. Other columns are ignored."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(rank, "v").limit(k).collect()
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not start:
        none = kept.select("id", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(""))
        return none.toDF(*names).limit(0)
    centroids = whole(np.array([r["v"] for r in start]), scale)
    drift, n, sums = np.zeros(len(centroids)), [0] * len(centroids), [[0] * dims for _ in centroids]
    with scratch(spark):
        blocks = staged(as_blocks(kept, dims, scale))
        for _ in range(rounds):
            blocks = staged(assigned_blocks(blocks, centroids, drift))
            new = moved(blocks, centroids, n, sums)
            drift, centroids = drifted(drift, centroids, new), new
        out = staged(settled(assigned_blocks(blocks, centroids, drift), centroids), keep=True)
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), *names[1:])  # a row for each of k clusters
