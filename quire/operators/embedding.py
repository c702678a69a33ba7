"""Texts to vectors: batches for a model, and a table of what it gave before."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.staging import file_system, staged

#: Buckets of the words that a worker has met, so that a word is hashed once.
_buckets: dict[str, int] = {}


def hashing_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Deterministic stand-in for a model: words hashed into signed buckets."""
    if len(_buckets) > 1_000_000:  # of one worker; it starts anew
        _buckets.clear()
    at, n = [], []
    for t in texts:
        words = t.lower().split()
        n.append(len(words))
        for w in words:
            h = _buckets.get(w)
            if h is None:
                h = _buckets[w] = zlib.crc32(w.encode())
            at.append(h)
    h = np.array(at, np.int64)
    place = np.repeat(np.arange(len(texts)), n) * dim + h % dim
    return np.bincount(place, np.where(h >> 31, 1.0, -1.0), len(texts) * dim).reshape(-1, dim)


def unit_vectors(fn: Callable[[list[str]], np.ndarray], texts: list[str], dim: int | None) -> tuple[np.ndarray, list[str | None]]:
    """Unit vectors of some texts and the error of each. If the model fails, each half of the texts is tried for itself, so that a
    text that it can't take has a zero vector of `dim` numbers and takes no other with it. Without dim the failure is raised."""
    try:
        v = np.asarray(fn(texts), float)
        if v.shape != (len(texts), dim or v.shape[-1]):
            raise ValueError(f"the model gave an array of {v.shape} for {len(texts)} texts")
    except Exception as e:  # whatever a caller's model raises
        if dim is None:
            raise
        if len(texts) == 1:
            return np.zeros((1, dim)), [f"{type(e).__name__}: {e}"]
        half = len(texts) // 2
        (a, x), (b, y) = unit_vectors(fn, texts[:half], dim), unit_vectors(fn, texts[half:], dim)
        return np.concatenate([a, b]), x + y
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0), [None] * len(texts)


def embed_batches(df: DataFrame, column: str, fn: Callable[[list[str]], np.ndarray] = hashing_embed, prefix: str = "passage: ", batch: int = 100, out: str = "embedding", dim: int | None = None, error: str | None = None) -> DataFrame:
    """Unit vectors of the texts, `batch` at a time; a zero vector stays zero. With dim, a text that the model fails for has a zero
    vector of dim numbers, and the column `error`, if it is named, says why. A null text is the empty one. An empty table
    gives no rows."""
    more = [T.StructField(out, T.ArrayType(T.DoubleType())), *([T.StructField(error, T.StringType())] if error else [])]
    names = [*df.columns, *(f.name for f in more)]

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                v, errors = unit_vectors(fn, [prefix + (t or "") for t in part.column(column).to_pylist()], dim)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *([pa.array(errors, pa.string())] if error else [])], names=names)

    return df.mapInArrow(embed, T.StructType([*df.schema.fields, *more]))


def embed_cached(df: DataFrame, column: str, cache: str, dim: int, fn: Callable[[list[str]], np.ndarray] = hashing_embed, prefix: str = "passage: ", batch: int = 100) -> DataFrame:
    """df with `embedding` and `how` it came: reused (the cache had its content), new, or failed (a zero vector, not stored, so
    that it is tried again the next time).

    cache: the folder of a table of vectors by the digest of prefix and content, for one model. Only contents that it lacks, each once,
    are embedded and appended. Of two jobs that append the same content at once, either's vector serves. Other columns stay;
    df may not have columns of the names made here."""
    spark = df.sparkSession
    rows = df.withColumn("digest", F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col(column), F.lit(""))), 256))
    fs, place = file_system(spark, cache)
    stored = spark.read.schema("digest string, embedding array<double>").parquet(cache) if fs.exists(place) else spark.createDataFrame([], "digest string, embedding array<double>")
    known = staged(stored.join(rows.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"]))
    fresh = rows.select("digest", F.coalesce(F.col(column), F.lit("")).alias("content")).join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    made = staged(embed_batches(fresh, "content", fn, prefix, batch, dim=dim, error="error").drop("content"))
    made.where("error is null").select("digest", "embedding").write.mode("append").parquet(cache)
    vectors = known.withColumn("how", F.lit("reused")).unionByName(made.select("digest", "embedding", F.when(F.col("error").isNull(), "new").otherwise("failed").alias("how")))
    return rows.join(vectors, "digest").drop("digest")
