"""Pipeline over `documents`: quality rules, line dedup, near duplicates, mixing to target weights, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import scratch, short_batches, staged, table
from quire.llm.line_dedup import line_dedup
from quire.llm.mixing import mix_to_targets
from quire.llm.near_duplicates import near_duplicates
from quire.llm.packing import best_fit_packing
from quire.llm.quality import quality_rules
from quire.llm.queries import MIX, trusted_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that mixing keeps.
MIXED = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; every row by its own verdict, whatever its doc_id."""
    short_batches(spark)
    return quality_rules(docs, trusted_ids(spark, sf_dir), carry=tuple(COLUMNS[1:])).where("kept").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that occur in ten or more. Copies of a whole text count once here: they are the next
    stage's to remove, and a text with ten copies would otherwise lose all its lines in each."""
    out = line_dedup(docs, min_docs=10, copies_once=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, one with the smallest doc_id. Rows that share a doc_id, or have none, are
    documents of their own."""
    short_batches(spark)
    return near_duplicates(docs, threshold=0.8, ngram=5, carry=tuple(COLUMNS[1:])).where("stays").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities that are calibrated to the target shares of sources, languages and topics."""
    short_batches(spark)
    out = mix_to_targets(docs.withColumn("row", F.struct(*[c for c in COLUMNS if c != "text"])), MIX, fraction=MIXED, carry=("row", "text"))
    return out.where("kept").select(*["text" if c == "text" else f"row.{c}" for c in COLUMNS])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in sequences of at most 4096 tokens."""
    short_batches(spark)
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1)


STAGES = [("quality rules", quality), ("line dedup", without_common_lines), ("n-gram jaccard join", one_of_each), ("mixing sources", mixed), ("best-fit packing", packed)]
#: Minimum hashes, tokenizers and raking can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):  # each stage's output is deleted when the last one has been written
        for _, stage in STAGES:
            with scratch(spark):  # what a stage staged for itself goes with it
                docs = staged(stage(spark, docs, sf_dir), keep=True)
        docs = staged(docs, keep=True)
    return docs
