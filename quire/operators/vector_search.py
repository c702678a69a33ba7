"""Nearest vectors: exact, and by a stored inverted file of cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.operators.catalog import rank_hits
from quire.sources.staging import new_path, staged

#: Digits after the point of a similarity, so that equal ones tie in whatever order they were summed.
DIGITS = 10
#: Queries (rows of vectors) that go to the workers at once; more are taken block by block.
QUERY_BLOCK = 10_000
#: Vectors that an index's cells are fitted on; of these, how many are looked up to say how many cells to probe.
INDEX_SAMPLE, MEASURED = 10_000, 256
#: Vectors of a cell that meet in one task; queries that are compared at once.
CELL_PART, AT_ONCE = 50_000, 2_000
#: The exact search compares TILE queries with ROWS vectors at once (16 MB of scores); pairs that are scored one by one, at once.
TILE, ROWS, PAIRS = 256, 8_192, 1 << 15
#: By how much a score of many at once and one of a pair may differ, in parts of the vectors' size: far more than they do.
SLACK = 1e-9


def usable_rows(b: pa.RecordBatch, column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose vector has `dim` components, none null or non-finite, and the matrix of these vectors."""
    lists = b.column(column)
    rows = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    v = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    good = np.isfinite(v).all(1)
    return rows[good], v[good]


def dimension(queries: DataFrame, vector: str) -> int | None:
    """The length that most queries' vectors have."""
    return queries.where(F.size(vector) > 0).agg(F.mode(F.size(vector), True)).first()[0]


def joined(best: tuple | None, rows: np.ndarray, names: np.ndarray, s: np.ndarray, k: int) -> tuple:
    """The k best (query number, name, score) of each query, of what was best and what is new; ties by name."""
    now = (rows, names, s) if best is None else tuple(map(np.concatenate, zip(best, (rows, names, s), strict=True)))
    order = np.lexsort((now[1], -now[2], now[0]))
    rows = now[0][order]
    return tuple(x[order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]] for x in now)


def above(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of scores that are among the k best of their row, ties included."""
    at = max(0, s.shape[1] - k)
    return np.nonzero(s >= np.partition(s, at, axis=1)[:, [at]])


def fewer_copies(names: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the k with the smallest names: no query can have others of them among its k best."""
    v = np.ascontiguousarray(v)
    _, group, n = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    if n.max() <= k:
        return names, v
    order = np.lexsort((names, group))
    order = order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < k]
    return names[order], v[order]


def rough_scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Of many at once, all placeable(); near enough to see which pairs are worth scoring."""
    return q @ v.T if metric == "cosine" else 2 * (q @ v.T) - (q**2).sum(1)[:, None] - (v**2).sum(1)


def best_of_tile(best: tuple | None, s: np.ndarray, q: np.ndarray, names: np.ndarray, v: np.ndarray, k: int, one_by_one: Callable, slack: float) -> tuple:
    """`best` of these queries after some more vectors, of which the rough scores are s. Pairs that may be among the k best of their query are scored one by one, always
    in the same way, so that equal vectors have equal scores wherever they stand."""
    bound = np.full(len(q), -np.inf) if best is None else best[3]
    if np.isinf(bound).any():  # some query has not had k vectors yet
        at = max(0, s.shape[1] - k)
        bound = np.maximum(bound, np.partition(s, at, axis=1)[:, at])
    rows, cols = np.nonzero(s >= (bound - slack)[:, None])
    if not len(rows) and best is not None:
        return best
    s = np.concatenate([one_by_one(q[rows[i : i + PAIRS]], v[cols[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS)])
    out = joined(best and best[:3], rows, names[cols], s, k)
    last = np.full(len(q), -np.inf)
    place = np.arange(len(out[0])) - np.searchsorted(out[0], out[0])
    last[out[0][place == k - 1]] = out[2][place == k - 1]
    return *out, last


def best_of(frame: DataFrame, ids: list, q: np.ndarray, k: int, metric: str, vector_id: str, vector: str) -> DataFrame:
    """The k best vectors of each query in each task. Vectors that don't have the queries' length are passed over. A task compares
    tiles of queries and vectors: its memory depends on neither's number but for k names and scores of each query."""
    kind, one_by_one = dict(frame.dtypes)[vector_id], PAIR_METRICS[metric]
    arrow = to_arrow_type(frame.schema[vector_id].dataType)
    most = float((q**2).sum(1).max(initial=0))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, ready = range(0, len(q), TILE), placeable(q, metric)
        best: dict = dict.fromkeys(tiles)  # at most k for each query, over all batches of the task
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            at, v = usable_rows(b, vector, q.shape[1])
            if len(at):
                names, v = fewer_copies(np.array(b.column(vector_id).take(pa.array(at)).to_pylist()), v, k)
                slack = SLACK * (1 if metric == "cosine" else 1 + most + float((v**2).sum(1).max()))
                own = placeable(v, metric)
                for t in tiles:
                    best[t] = best_of_tile(best[t], rough_scores(ready[t : t + TILE], own, metric), q[t : t + TILE], names, v, k, one_by_one, slack)
        for t in tiles:
            if best[t] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([ids[t + i] for i in best[t][0]], pa.int64()), pa.array(best[t][1].tolist(), arrow), pa.array(best[t][2], pa.float64())], names=["query_id", vector_id, "similarity"])

    return frame.mapInArrow(search, f"query_id long, {vector_id} {kind}, similarity double")


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    return np.round(np.divide(q @ v.T, size, out=np.zeros((len(q), len(v))), where=size > 0), DIGITS)


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.round(-((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T), DIGITS)


def cosine_pairs(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each row of q with the same row of v."""
    size = np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1)
    return np.round(np.divide((q * v).sum(1), size, out=np.zeros(len(q)), where=size > 0), DIGITS)


def distance_pairs(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.round(-((q - v) ** 2).sum(1), DIGITS)


METRICS = {"cosine": cosines, "l2": distances}
PAIR_METRICS = {"cosine": cosine_pairs, "l2": distance_pairs}


class query_blocks:
    """The stated queries, at most about QUERY_BLOCK at a time: lists of ids and matrices, of n blocks."""

    def __init__(self, queries: DataFrame, query_id: str, vector: str):
        dim = dimension(queries, vector)
        good = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
        rows = queries.where(F.lit(False) if dim is None else good)
        self.rows, self.query_id, self.n = rows.select(query_id, vector), query_id, -(-rows.count() // QUERY_BLOCK)

    def __iter__(self) -> Iterator[tuple[list, np.ndarray]]:
        for k in range(self.n):
            part = self.rows if self.n == 1 else self.rows.where(F.pmod(F.xxhash64(self.query_id), F.lit(self.n)) == k)
            rows = part.collect()
            if rows:
                yield [r[0] for r in rows], np.array([r[1] for r in rows], float)


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, vector_id, similarity (for l2: minus the squared distance), rank. Queries are matrices in the workers, which
    are compared tile by tile; each task keeps its k best vectors of each, and only those are ranked. `where` filters vectors before. A vector or query
    that is null, holds a null or isn't as long as most queries is in no result."""
    rows = (vectors if where is None else vectors.where(where)).select(vector_id, vector)
    found, blocks = None, query_blocks(queries, query_id, vector)
    for ids, q in blocks:
        hits = best_of(rows, ids, q, k, metric, vector_id, vector)
        if blocks.n > 1:  # a block's hits are written before the next one is taken to the driver
            hits = staged(hits)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = best_of(rows.limit(0), [], np.zeros((0, 1)), k, metric, vector_id, vector)
    return rank_hits(found, "query_id", "similarity", k, vector_id)


# ---- inverted file -------------------------------------------------------------------------------------------------------


class VectorIndex:
    """Vectors below a folder by the cell of their nearest centre: `cells` (id, vector; a folder for each cell), and a row of what
    searching needs: centres, metric and how many cells to probe."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.schema(META).json(f"{path}/meta").first()
        self.metric, self.nprobe, self.kind = meta["metric"], meta["nprobe"], meta["kind"]
        self.centres = np.array(meta["centres"], float)

    def cells(self, numbers: list[int] | None = None) -> DataFrame:
        """cell, id, vector of the given cells; other folders are not read."""
        rows = self.spark.read.schema(f"id {self.kind}, vector array<double>, cell int").parquet(f"{self.path}/cells")
        return rows if numbers is None else rows.where(F.col("cell").isin(numbers))


META = "metric string, nprobe int, kind string, centres array<array<double>>"


def placeable(v: np.ndarray, metric: str) -> np.ndarray:
    """For cosine, cells are those of unit vectors."""
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0) if metric == "cosine" else v


def nearest_cells(v: np.ndarray, centres: np.ndarray, metric: str, n: int) -> np.ndarray:
    return np.argsort(-distances(placeable(v, metric), centres), 1, kind="stable")[:, :n]


def placed(rows: DataFrame, id_col: str, vector: str, centres: np.ndarray, metric: str, n: int) -> DataFrame:
    """id, vector, cell: rows with the n nearest cells of their vector, one row for each. Vectors that aren't usable go."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = usable_rows(b, "vector", centres.shape[1])
            if len(at):
                cells = nearest_cells(v, centres, metric, n).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), lists(v), lists(cells)], names=["id", "vector", "cells"])

    rows = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    out = rows.mapInArrow(place, f"id {dict(rows.dtypes)['id']}, vector array<double>, cells array<int>")
    return out.select("id", "vector", F.explode("cells").alias("cell"))


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    centres = sample[: min(cells, len(sample))]
    for _ in range(15):
        near = distances(sample, centres).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build_vector_index(vectors: DataFrame, path: str, nlist: int | None = None, metric: str = "cosine", recall: float = 0.95, k: int = 10, vector_id: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Store the vectors below `path` by cell: nlist cells (as many as the root of the number of vectors, at most 4096), fitted on
    INDEX_SAMPLE of them; every usable vector has a cell. How many cells a search probes is measured here: as few as give
    MEASURED of the vectors, looked up among all the others, `recall` of their k exact neighbours. A path holds one index."""
    spark, dim = vectors.sparkSession, dimension(vectors, vector)
    if dim is None:
        raise ValueError("there is no vector to fit an index on")
    usable = vectors.where((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))).select(vector_id, F.col(vector).cast("array<double>").alias(vector))
    rows = usable.orderBy(F.xxhash64(vector_id), vector_id).limit(INDEX_SAMPLE).collect()
    sample = placeable(np.array([r[1] for r in rows], float), metric)
    centres = fitted(sample, nlist or max(8, min(4096, math.isqrt(usable.count()))))
    cells = placed(usable, vector_id, vector, centres, metric, 1)
    cells.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/cells")
    some = spark.createDataFrame([(i, *r) for i, r in enumerate(rows[:MEASURED])], f"query_id long, self {dict(vectors.dtypes)[vector_id]}, {vector} array<double>")
    exact = knn_exact(some, usable, k + 1, metric, "query_id", vector_id, vector)
    pairs = exact.join(some.select("query_id", "self", F.col(vector).alias("asked")), "query_id").where(~F.col("self").eqNullSafe(F.col(vector_id)))
    pairs = pairs.where(F.col("rank") <= k + 1).join(usable, vector_id).select("asked", vector).collect()  # k times MEASURED rows
    nprobe = len(centres)
    if pairs:
        order = nearest_cells(np.array([r[0] for r in pairs], float), centres, metric, len(centres))
        own = nearest_cells(np.array([r[1] for r in pairs], float), centres, metric, 1)
        needed = np.sort((order == own).argmax(1) + 1)
        nprobe = int(needed[math.ceil(recall * len(needed)) - 1])
    spark.createDataFrame([(metric, nprobe, dict(vectors.dtypes)[vector_id], centres.tolist())], META).coalesce(1).write.json(f"{path}/meta")
    return VectorIndex(spark, path)


def add_vectors(index: VectorIndex, new: DataFrame, vector_id: str = "vec_id", vector: str = "embedding") -> None:
    """Store further vectors in the cells that the index has."""
    placed(new, vector_id, vector, index.centres, index.metric, 1).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{index.path}/cells")


def search_vectors(queries: DataFrame, index: VectorIndex, k: int, nprobe: int | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """As knn_exact (with vec_id), over the nprobe nearest cells of each query.

    Only the folders of probed cells are read. A query meets the vectors of the cells it probes and no others: both are joined
    by cell. A cell's vectors are dealt to as many tasks as CELL_PART asks for, so that no task holds a large cell; each gives
    its k best of a query. Neither side passes the driver but for the numbers of the cells that are probed."""
    spark, score, kind = queries.sparkSession, METRICS[index.metric], index.kind
    asked = staged(placed(queries, query_id, vector, index.centres, index.metric, nprobe or index.nprobe).select(F.col("id").cast("long").alias("query_id"), F.col("vector").alias("asked"), "cell"))
    cells = index.cells([r[0] for r in asked.select("cell").distinct().collect()])
    parts = staged(cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL_PART).alias("parts")))  # a row for each cell
    rows = cells.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "vector")
    asked = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("cell", "part", "query_id", "asked")
    arrow, dim = to_arrow_type(rows.schema["id"].dataType), index.centres.shape[1]

    def search(key: tuple, v: pa.Table, q: pa.Table) -> pa.Table:
        out = [], [], []
        if v.num_rows and q.num_rows:
            matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            names, own, ids = np.array(v.column("id").to_pylist()), matrix(v, "vector"), q.column("query_id").to_numpy()
            for at in range(0, q.num_rows, AT_ONCE):
                s = score(matrix(q.slice(at, AT_ONCE), "asked"), own)
                hit, cols = above(s, k)
                for column, x in zip(out, joined(None, hit, names[cols], s[hit, cols], k), strict=True):
                    column.append(x if column is not out[0] else ids[at + x])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(flat[0], pa.int64()), pa.array(flat[1].tolist(), arrow), pa.array(flat[2], pa.float64())], names=["query_id", "vec_id", "similarity"])

    found = rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(search, f"query_id long, vec_id {kind}, similarity double")
    return rank_hits(found, "query_id", "similarity", k, "vec_id")


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int, nlist: int | None = None, nprobe: int | None = None, metric: str = "cosine", query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding", recall: float = 0.95) -> DataFrame:
    """As knn_exact, by an index that is built for this call alone. For more than one search, build_vector_index() and
    search_vectors()."""
    if dimension(vectors, vector) is None:
        return knn_exact(queries, vectors, k, metric, query_id, vector_id, vector)
    index = build_vector_index(vectors, new_path(queries.sparkSession, "vector-index"), nlist, metric, recall, k, vector_id, vector)
    return search_vectors(queries, index, k, nprobe, query_id, vector).withColumnRenamed("vec_id", vector_id)
