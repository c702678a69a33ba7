"""Helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.staging import new_path, scratch, shared_folder, staged  # noqa: F401

#: ASCII white space, the only characters that separate words or are stripped from lines here.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark's limit of the bytes of rows that go to a Python worker at a time, and the one that short_batches() sets. One row may
#: exceed it.
BATCH_BYTES, SHORT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def short_batches(spark: SparkSession) -> None:
    """Send rows to Python workers in batches of SHORT bytes, if the session has no limit of its own. Spark's default of 64 MiB, or
    10,000 rows, is held several times over by each task: in the JVM on both ways, and in its worker. It stays set, as
    Spark looks it up when a table is written, after the function that made the table has returned."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, SHORT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the same for pure ASCII and much faster than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def broadcast_if_small(df: DataFrame, n_rows: int, most: int) -> DataFrame:
    """Mark df for broadcasting if its counted rows are at most `most`; beyond that the join shuffles."""
    return F.broadcast(df) if n_rows <= most else df.hint("merge")
