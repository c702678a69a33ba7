"""Many keywords in many texts: one pass of an automaton over each text, however many keywords there are."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.text_index import texts_with

#: Characters of keywords that an automaton in every worker may hold; more keywords are looked up by grams.
MOST_CHARS = 4_000_000
#: Findings that a worker gathers before it hands them on.
GATHERED = 100_000


def automaton_of(words: list[str]) -> ahocorasick.Automaton:
    """An automaton that gives the numbers of the words."""
    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(w, i)
    found.make_automaton()
    return found


def keyword_hits(chunks: DataFrame, keywords: DataFrame, chunk_id: str = "chunk_id", content: str = "content") -> DataFrame:
    """keyword, chunk_id of every chunk that holds a keyword of keywords(keyword), whatever the case, inside words too. Null and
    empty keywords are left out; rows that share an id count as one. Up to MOST_CHARS of keywords come to the driver."""
    words = keywords.where(F.col("keyword") != "").select("keyword", F.lower("keyword").alias("low")).distinct()
    texts = chunks.select(F.col(chunk_id).alias("id"), F.lower(content).alias("text")).where("text is not null")
    size = words.agg(F.coalesce(F.sum(F.char_length("low")), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        found = texts_with(texts, words.select("low").distinct(), "id", "text", "low", "low")
        return words.join(found, "low").select("keyword", F.col("id").alias(chunk_id)).distinct()
    shared = chunks.sparkSession.sparkContext.broadcast(sorted({r[0] for r in words.select("low").collect()}))
    kind = dict(texts.dtypes)["id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        automaton = automaton_of(words)
        for b in batches:
            rows, hits = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                for i in {i for _, i in automaton.iter(text)} if words else ():
                    rows.append(k)
                    hits.append(words[i])
                if len(rows) > GATHERED or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["id", "low"])
                    rows, hits = [], []

    found = texts.mapInArrow(search, f"id {kind}, low string").where("id is not null")
    return words.join(found, "low").select("keyword", F.col("id").alias(chunk_id)).distinct()


def keyword_coverage(chunks: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """workspace_id, sensor_type, covered for every workspace of `chunks` (workspace_id, content) and every type: whether a
    keyword of the type is inside a lower-cased chunk; the empty keyword is in every chunk that isn't null. A worker hands on which
    types it has found in a workspace, once; texts are not moved."""
    types = list(keywords)
    of_word: dict[str, list[int]] = {}
    for i, t in enumerate(types):
        for w in keywords[t]:
            of_word.setdefault(w, []).append(i)
    always = of_word.pop("", [])
    shared = chunks.sparkSession.sparkContext.broadcast(sorted(of_word.items()))
    texts = chunks.select(F.col("workspace_id").alias("id"), F.lower("content").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for w, _ in shared.value]
        kinds = [frozenset(k) for _, k in shared.value]
        automaton, seen, id_type = automaton_of(words), {}, None

        def out() -> Iterator[pa.RecordBatch]:
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), id_type), pa.array([sorted(x) for x in seen.values()], pa.list_(pa.int32()))], names=["id", "types"])
            seen.clear()

        for b in batches:
            id_type = b.column("id").type
            for workspace, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                has = seen.setdefault(workspace, set())
                if text is not None:
                    has.update(always)
                    if words and len(has) < len(types):
                        for _, i in automaton.iter(text):
                            has |= kinds[i]
                if len(seen) > GATHERED:
                    yield from out()
        yield from out()

    found = texts.mapInArrow(search, f"id {dict(texts.dtypes)['id']}, types array<int>").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    pairs = F.transform(F.array(*map(F.lit, types)), lambda t, i: F.struct(t.alias("sensor_type"), F.array_contains("types", i).alias("covered")))
    return found.select(F.col("id").alias("workspace_id"), F.inline(pairs))
