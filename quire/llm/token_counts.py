"""Token counts with a digest cache: only contents that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import staged

CACHE_SCHEMA = "content string, tokenizer string, n_bytes long, n_tokens long"


def digest_of_file(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str):
    """Counts the tokens of a list of texts. .model: sentencepiece; .json: tokenizers."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, content: SHA-256 of the normalised text (null becomes "")."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("content"))


def cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """What the cache holds for a tokenizer; None if there is no cache yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode the contents of docs that the cache lacks and append their counts; the tokenizer's digest.

    Contents are made distinct first inside each task, then by digest, so that copies of a text meet as at most one row a
    task. The tokenizer's file must exist at tokenizer_path on every executor, as installed files do, or have been added by
    SparkContext.addFile. One writer at a time may append; a content that two writers add counts once."""
    version, name = digest_of_file(tokenizer_path), tokenizer_path.rsplit("/", 1)[-1]
    missing = keyed(docs, id_col, text_col).select("content", "text").dropDuplicates(["content"])
    known = cached(docs.sparkSession, cache_path, version)
    if known is not None:
        missing = missing.join(known.select("content"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        count = _counter(tokenizer_path if os.path.exists(tokenizer_path) else SparkFiles.get(name))
        for b in batches:
            for k in range(0, b.num_rows, 64):  # few texts at a time: their ids are large
                part = b.slice(k, 64)
                texts = part.column("text").to_pylist()
                sizes = [len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array([version] * len(texts)), pa.array(sizes, pa.int64()), pa.array(count(texts), pa.int64())], names=["content", "tokenizer", "n_bytes", "n_tokens"])

    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return version


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row's whole text, by way of the cache at cache_path:
    contents that it lacks for this tokenizer are encoded once and appended (fill_cache), then all rows get their counts by a
    join with the cache, on the digest of their content. A second call encodes only new contents.

    Null and empty text: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are. An empty table gives no rows and
    an empty cache. Other columns are ignored.
    """
    version = fill_cache(docs, tokenizer_path, cache_path, id_col, text_col)
    counts = cached(docs.sparkSession, cache_path, version)
    # Written once more, so that adaptive execution can split a content that very many rows have.
    counts = staged(counts.groupBy("content").agg(F.first("n_bytes").alias("n_bytes"), F.first("n_tokens").alias("n_tokens")))
    out = keyed(docs, id_col, text_col).select("id", "content").join(counts, "content")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
