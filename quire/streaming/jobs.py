"""Continuous ingestion and document states."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.operators.store import Store
from quire.sources.staging import file_system

# The order of states.
ORDER = ["pending", "ocr_completed", "chunked", "indexed"]


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files that arrive at `path`, one document each: document_id (the file's name), arrived, text."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(path)
    return files.select(F.col("_metadata.file_name").alias("document_id"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").alias("text"))


#: Rows that a document's work gives at once.
AT_ONCE = 1000
STATES = "file_hash string, document_id {kind}, status string, error string, batch long"


def each_document(work: Callable[[dict], Iterable[tuple]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """Work for ingest_stream(): `work` takes a document as a dict of its columns and gives rows of the schema. What it raises
    becomes the document's error, a row with nothing else; its other rows are dropped. Documents do not meet."""

    def run(docs: DataFrame) -> DataFrame:
        kind = T.StructType([T.StructField("file_hash", T.StringType()), T.StructField("error", T.StringType()), *T.StructType.fromDDL(schema).fields])
        arrow, names = to_arrow_schema(kind), kind.fieldNames()

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                for k in range(b.num_rows):
                    doc = b.slice(k, 1).to_pylist()[0]
                    try:
                        rows += [(doc["file_hash"], None, *r) for r in list(work(doc))]
                    except Exception as e:  # whatever the caller's work raises
                        rows.append((doc["file_hash"], f"{type(e).__name__}: {e}", *[None] * (len(names) - 2)))
                    if len(rows) > AT_ONCE or k == b.num_rows - 1:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)
                        rows = []

        return docs.mapInArrow(each, kind)

    return run


def ingest_stream(docs: DataFrame, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], retries: int = 3, within: str = "1 hour") -> StreamingQuery:
    """Documents of a stream (document_id, arrived, text) are worked on batch by batch and written to `target`/data as Parquet, with
    a state per document in `target`/states: indexed or error, with the error. Ends when all present input is done.

    A content counts once: of copies that come within `within` of each other the stream passes on one, and contents that are indexed
    already are passed over. `work` (see each_document()) gives rows with file_hash and `error`: a document with an error has
    no rows in the data (these lie under failed=false) and takes no other with it. It is worked on again with the next batches, up to `retries` times in
    all, and whenever it comes again after that. If the work itself fails (a library is missing, the storage is down), the
    batch fails and is repeated when the stream is started again: no document is marked for it.

    A batch is three writes, however many documents fail: what arrived, what the work gave, the states. They go to folders
    of its number, so a batch that is repeated replaces itself."""
    docs = docs.withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("seen", F.current_timestamp())
    docs = docs.withWatermark("seen", within).dropDuplicatesWithinWatermark(["file_hash"]).drop("seen")
    states_kind = STATES.format(kind=dict(docs.dtypes)["document_id"])

    def save(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        fs, place = file_system(spark, f"{target}/states")
        if fs.exists(place):
            states = spark.read.schema(states_kind).parquet(f"{target}/states").where(F.col("batch") != number)
            told = states.groupBy("file_hash").agg(F.bool_or(F.col("status") == "indexed").alias("done"), F.count("*").alias("tries"), F.min("batch").alias("batch"))
            batch = batch.join(told.where("done").select("file_hash"), "file_hash", "left_anti")
            failed = told.where(~F.col("done") & (F.col("tries") < retries)).select("file_hash", "batch")
            first = [r[0] for r in failed.select("batch").distinct().collect()]  # only these batches' arrivals are read
            if first:
                before = spark.read.schema(schema.add("batch", "long")).parquet(f"{target}/arrived").where(F.col("batch").isin(first))
                schema = batch.schema
                again = before.join(failed.select("file_hash", "batch"), ["file_hash", "batch"], "left_semi")
                batch = batch.select(*schema.fieldNames()).unionByName(again.select(*schema.fieldNames())).dropDuplicates(["file_hash"])
        batch.write.mode("overwrite").parquet(f"{target}/arrived/batch={number}")
        batch = spark.read.schema(batch.schema).parquet(f"{target}/arrived/batch={number}")
        made = work(batch)
        out = f"{target}/data/batch={number}"
        made.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(out)
        errors = spark.read.schema(made.schema.add("failed", "boolean")).parquet(out).where("failed").groupBy("file_hash").agg(F.min("error").alias("error"))
        status = F.when(F.col("error").isNull(), "indexed").otherwise("error")
        batch.select("document_id", "file_hash").join(errors, "file_hash", "left").withColumn("status", status).write.mode("overwrite").parquet(f"{target}/states/batch={number}")

    return docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(events: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest status of each document, by the time of its events, in a table of a store: document_id, ts, event_id, status.

    The stream keeps no state: what is known is the table. A batch is folded to a row for each of its documents, and only the
    buckets that these fall into are rewritten; an event that comes late changes nothing if a later one is there, and a batch
    that is repeated changes nothing either. Ends when all present input is done."""
    columns = ["document_id", "ts", "event_id", "status"]
    if name not in store.state()[1]:
        store.create(name, store.spark.createDataFrame([], events.select(*columns).schema), "document_id")

    def save(batch: DataFrame, number: int) -> None:
        store.upsert(name, batch.select(*columns), "document_id", "ts", newer=True)

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Steps(StatefulProcessor):
    """A document's last status, and the events that wait until the watermark has passed their time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for f in rows for r in zip((f["ts"].astype("datetime64[us]").astype("int64")).tolist(), f["event_id"].tolist(), f["status"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(ts for ts, _, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = ([r for r in waiting if (r[0] // 1000 < upto) == now] for now in (True, False))
        last, at = self.last.get() if self.last.exists() else (None, 0)
        if due:
            legal, due = [], sorted(due)
            for ts, _, status in due:
                place = ORDER.index(last) if last in ORDER else -1
                legal.append(status == "error" or (status in ORDER and ORDER.index(status) == place + 1))
                last, at = status, ts // 1000
            self.last.update((last, at))
            self.handle.registerTimer(at + self.keep_ms)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            yield pd.DataFrame({"document_id": [key[0]] * len(due), "event_id": [r[1] for r in due], "status": [r[2] for r in due], "legal": legal})
        elif last is not None and not waiting and upto >= at + self.keep_ms:
            self.last.clear()
        if later:
            self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1)

    def close(self) -> None:
        pass


def flag_transitions(events: DataFrame, late: str = "1 hour", keep_days: int = 365) -> DataFrame:
    """Each event (document_id, event_id, ts, status) with whether its step is allowed: to the next state in ORDER, or to error from
    any.

    Events wait until the watermark, `late` behind the newest time of all, has passed theirs, and are then judged in the order of their
    times, whatever the order they came in; one that comes later than that is passed over. A document's last status is kept
    for `keep_days` of event time after its last event; one that goes on after that begins anew. The last `late` of a
    stream is judged when later events come."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("document_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late)
    kind = dict(events.dtypes)["document_id"]
    return rows.groupBy("document_id").transformWithStateInPandas(Steps(keep_days * 86_400_000), f"document_id {kind}, event_id long, status string, legal boolean", "append", "eventtime")
