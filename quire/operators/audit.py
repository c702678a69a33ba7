"""Audits of an index against the chunks on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip


def counts_of(registry: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    v = vectors.groupBy("document_id").agg(F.count("*").alias("vectors"))
    out = registry.select("document_id").join(c, "document_id", "left").join(v, "document_id", "left")
    return out.fillna(0, ["chunks", "vectors"])


def index_count_audit(registry: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document: PASS, FAIL with the signed difference, or WARN without chunks."""
    delta = F.col("vectors") - F.col("chunks")
    verdict = F.when(F.col("chunks") == 0, "WARN").when(delta == 0, "PASS").otherwise(F.format_string("FAIL(%+d)", delta))
    return counts_of(registry, chunks, vectors).withColumn("verdict", verdict)


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count("*").alias("total"))


def vector_count_check(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document with chunks: indexed if as many vectors are stored, else error."""
    out = counts_of(chunks.select("document_id").distinct(), chunks, vectors)
    return out.withColumn("status", F.when(F.col("chunks") == F.col("vectors"), "indexed").otherwise("error"))


def index_content_audit(chunks: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Per chunk with a vector: whether the stripped texts are equal, which metadata differ as text, and both together."""
    v = vectors.select("chunk_id", F.col("text").alias("v_text"), *[F.col(k).alias(f"v_{k}") for k in keys])
    wrong = F.array_compact(F.array(*[F.when(~F.col(k).cast("string").eqNullSafe(F.col(f"v_{k}").cast("string")), F.lit(k)) for k in keys]))
    rows = chunks.join(v, "chunk_id").withColumn("text_ok", strip(F.col("text")) == strip(F.col("v_text"))).withColumn("wrong_keys", wrong)
    return rows.select("chunk_id", "text_ok", "wrong_keys", (F.col("text_ok") & (F.size("wrong_keys") == 0)).alias("passed"))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def stale_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return missing_vectors(vectors, chunks)


def embedding_dim_check(vectors: DataFrame, dim: int) -> DataFrame:
    """Smallest and largest dimension of all vectors, and whether all have `dim`."""
    out = vectors.agg(F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"))
    return out.withColumn("matches", F.coalesce((F.col("min_dim") == dim) & (F.col("max_dim") == dim), F.lit(True)))


def distance_quality(hits: DataFrame, k: int = 3) -> DataFrame:
    """The first k hits with a label of their distance and the first 100 signs of their text."""
    rows = hits.where(F.col("rank") <= k)
    return rows.withColumn("quality", F.when(F.col("distance") < 0.5, "good").otherwise("far")).withColumn("preview", F.substring("text", 1, 100)).drop("text")


def flatten_chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Columns of the struct `metadata` beside the others; `extra` as JSON text."""
    fields = chunks.schema["metadata"].dataType.names
    return chunks.select(*[c for c in chunks.columns if c != "metadata"], *[F.to_json("metadata.extra").alias("extra") if f == "extra" else F.col(f"metadata.{f}").alias(f) for f in fields])
