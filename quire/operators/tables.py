"""Maintenance of tables: each operation gives the new table; replace_table() swaps it in for readers of read_table()."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.audit import vector_count_check
from quire.operators.catalog import dedupe_by_hash, own_id
from quire.sources.staging import file_system

#: Ends an entry of a manifest.
END = "\nend\n"


def published(spark: SparkSession, manifest: str, most: int = 1) -> tuple[list[tuple[int, str]], int]:
    """The manifest's last entries, at most so many, oldest first: number and text; and the number of the next one. What isn't a
    whole entry is passed over."""
    fs, place = file_system(spark, manifest)
    numbers = sorted(int(n) for n in ([x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []) if n.isdigit())
    entries: list[tuple[int, str]] = []
    for number in reversed(numbers):
        lines = [r[0] for r in spark.read.text(f"{manifest}/{number:09d}", wholetext=True).collect()] if len(entries) < most else []
        if lines and lines[0].endswith(END):
            entries.insert(0, (number, lines[0].removesuffix(END)))
    return entries, numbers[-1] + 1 if numbers else 0


def publish(spark: SparkSession, manifest: str, number: int, text: str) -> None:
    """Make an entry: it is written under another name and renamed, so that it is there as a whole or not at all, and never in
    the place of another writer's."""
    fs, entry = file_system(spark, f"{manifest}/{number:09d}")
    _, draft = file_system(spark, f"{manifest}/.draft-{uuid.uuid4().hex}")
    fs.mkdirs(entry.getParent())
    out = fs.create(draft, False)
    out.write((text + END).encode())
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(entry).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(draft, entry, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if fs.exists(entry):
            raise ValueError("another writer has replaced the table") from e
        raise


def replace_table(df: DataFrame, path: str) -> str:
    """Write df as a new version below path, then name it in the manifest; return the version's folder. A job that dies at any step
    leaves the old version in use, readers of older versions are not disturbed, and of two writers that swap at once, one
    fails."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    publish(spark, f"{path}/manifest", published(spark, f"{path}/manifest")[1], version)
    return f"{path}/{version}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version that the manifest named last."""
    entries, _ = published(spark, f"{path}/manifest")
    if not entries:
        raise ValueError(f"no version of {path}")
    return spark.read.parquet(f"{path}/{entries[-1][1]}")


def last_of(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key, so that a key which is repeated has one result: the row with the greatest `order`, then with the greatest
    other columns in turn."""
    rest = [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    whole = F.struct(*rest)
    best = F.max_by(whole, whole if order is None else F.struct(F.col(order), whole))
    return rows.groupBy(key).agg(best.alias("row")).select(*[F.col(key) if c == key else F.col("row")[c].alias(c) for c in rows.columns])


def upsert(table: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of `new` replace those with the same key; of a key that `new` repeats, last_of() stays."""
    return table.join(new.select(key), key, "left_anti").unionByName(last_of(new, key, order))


def upsert_registry(registry: DataFrame, new: DataFrame, mode: str = "upsert") -> DataFrame:
    if mode == "insert" and not new.join(registry.select("document_id"), "document_id", "left_semi").isEmpty():
        raise ValueError("a document_id exists already")
    return upsert(registry, new, "document_id")


def set_status(table: DataFrame, changes: DataFrame, key: str = "document_id", column: str = "status") -> tuple[DataFrame, DataFrame]:
    """The table with new values of `column`, and the changes whose key it doesn't have; of repeated keys the last_of() counts."""
    changes = last_of(changes, key)
    c = changes.select(key, F.col(column).alias("new_value"))
    out = table.join(c, key, "left").withColumn(column, F.coalesce("new_value", F.col(column))).drop("new_value")
    return out, changes.join(table.select(key), key, "left_anti")


def ingest_batch(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """raw (path, length, content, file_hash, file_name, document_id, created_at) with a null reject_reason become pending records."""
    good = dedupe_by_hash(raw.where("reject_reason is null"), registry)
    first = good.groupBy("document_id").agg(F.min_by(F.struct("file_name", "created_at", "file_hash"), "file_name").alias("r"))
    new = first.select("document_id", "r.file_name", F.lit("pending").alias("status"), "r.created_at", "r.file_hash")
    return upsert_registry(registry, new.select(*registry.columns))


def upsert_vectors(vectors: DataFrame, new: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """The vectors after an upsert by chunk_id (a table of another dimension starts anew), and each new document's status."""
    other = not vectors.where(F.size("embedding") != dim).isEmpty()
    out = new if other else upsert(vectors, new, "chunk_id")
    return out, vector_count_check(new, out.join(new.select("document_id").distinct(), "document_id", "left_semi"))


def replace_file_chunks(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], keys: dict[str, str], ids: DataFrame, owner: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table less the rows of the documents in ids(id); keys: the column of each that holds the document. Also the ids
    that the owner table doesn't have."""
    left = {n: t.join(ids.select(F.col("id").alias(keys[n])), keys[n], "left_anti") for n, t in tables.items()}
    return left, ids.join(tables[owner].select(F.col(keys[owner]).alias("id")), "id", "left_anti")


def reindex(vectors: DataFrame, stored: DataFrame, ids: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Documents in ids(document_id) get their vectors anew from stored chunks (with embeddings); also ids without chunks."""
    chosen = stored.join(ids, "document_id", "left_semi")
    out, _ = upsert_vectors(vectors.join(ids, "document_id", "left_anti"), chosen, dim)
    return out, ids.join(stored.select("document_id").distinct(), "document_id", "left_anti")


def upsert_layer(layers: DataFrame, new: DataFrame) -> DataFrame:
    """By file_id; a layer that exists keeps its layer_id, a new one without any gets one made of its file_id."""
    old = layers.select("file_id", F.col("layer_id").alias("old_id"))
    made = own_id(layers, "layer_id", F.lit("layer"), F.col("file_id"))
    named = last_of(new, "file_id").join(old, "file_id", "left").withColumn("layer_id", F.coalesce("old_id", "layer_id", made)).drop("old_id")
    return upsert(layers, named.select(*layers.columns), "file_id")


def upsert_file(files: DataFrame, new: DataFrame) -> DataFrame:
    """New files start completed and pending; files that exist only get their states reset."""
    states = {"status": F.lit("completed"), "processing_status": F.lit("pending")}
    new = last_of(new, "file_id")
    again = files.join(new.select("file_id"), "file_id", "left_semi").withColumns(states)
    added = new.join(files.select("file_id"), "file_id", "left_anti").withColumns(states)
    return delete_rows(files, new, "file_id").unionByName(again).unionByName(added.select(*files.columns))


def link_sensor(sensors: DataFrame, links: DataFrame) -> DataFrame:
    new = last_of(links.select("sensor_id", "linked_file_id"), "sensor_id").select("sensor_id", F.col("linked_file_id").alias("new_link"))
    return sensors.join(new, "sensor_id", "left").withColumn("linked_file_id", F.coalesce("new_link", "linked_file_id")).drop("new_link")


def add_rows(table: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    filled = new.withColumns({c: F.coalesce(F.col(c), d) if c in new.columns else d for c, d in defaults.items()})
    return table.unionByName(filled, allowMissingColumns=True)
