"""Files, workspaces, sensors and registry: filters, joins, roll-ups and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import classify_file_type

# Accepted endings, sensor types with their labels (the first stands for unknown types).
ACCEPTED = ["pdf", "docx", "geojson", "json", "shp", "shapefile", "dbf", "shx", "prj"]
ACCEPTED_MIME = ["application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/geo+json", "application/json"]
SENSOR_TYPES = {
    "SMOKE": "Smoke", "TEMPERATURE": "Temperature", "MOTION": "Motion", "CAMERA": "Camera",
    "FLOOD": "Flood", "GAS": "Gas", "ACCESS_CONTROL": "Access control", "OTHER": "Other",
}


def accept_upload(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows, by content type or by the ending of the name."""
    ok = F.coalesce(F.col("content_type").isin(ACCEPTED_MIME), F.lit(False)) | F.coalesce(F.lower(F.element_at(F.split("filename", r"\."), -1)).isin(ACCEPTED), F.lit(False))
    return files.where(ok), files.where(~ok)


def route_upload(files: DataFrame) -> DataFrame:
    kind = classify_file_type(F.col("filename"))
    return files.withColumn("route", F.when(kind == "pdf", "document").when(kind == "docx", "text").when(kind == "geojson", "layer").otherwise("none"))


def files_filter(files: DataFrame, query: str = "", types: Sequence[str] = ()) -> DataFrame:
    out = files.where(F.contains(F.lower("filename"), F.lit(query.lower())))
    return out.where(F.col("file_type").isin(list(types))) if types else out


def workspaces_filter(workspaces: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return workspaces.where(F.contains(F.lower("name"), q) | F.coalesce(F.contains(F.lower("description"), q), F.lit(False)))


def chunks_with_files(chunks: DataFrame, files: DataFrame, workspace: str | None = None) -> DataFrame:
    files = files if workspace is None else files.where(F.col("workspace_id") == workspace)
    return chunks.join(files.select("file_id", "workspace_id", "filename"), "file_id")


def layers_with_files(layers: DataFrame, files: DataFrame, workspace: str | None = None) -> DataFrame:
    return chunks_with_files(layers, files, workspace)


def sensors_with_files(sensors: DataFrame, files: DataFrame) -> DataFrame:
    """Sensors with the linked file's name and the label of their type."""
    labels = F.create_map(*[F.lit(x) for pair in SENSOR_TYPES.items() for x in pair])
    first = next(iter(SENSOR_TYPES.values()))
    named = files.select(F.col("file_id").alias("linked_file_id"), "filename")
    return sensors.join(named, "linked_file_id", "left").withColumn("type_label", F.coalesce(F.try_element_at(labels, F.col("sensor_type")), F.lit(first)))


def linkable_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_type").isin("pdf", "docx"))


def effective_status(files: DataFrame, registry: DataFrame) -> DataFrame:
    """A pdf's status is the registry's where it has one; else the file's own; else unknown."""
    known = registry.select(F.col("document_id").alias("file_id"), F.col("status").alias("registry_status"))
    own = F.col("processing_status")
    status = F.when(F.col("file_type") == "pdf", F.coalesce("registry_status", own)).otherwise(own)
    return files.join(known, "file_id", "left").withColumn("status", F.coalesce(status, F.lit("unknown"))).drop("registry_status")


def own_id(table: DataFrame, column: str, *of: Column) -> Column:
    """An id made of the given values, in the type of the table's id column; the same whenever it is worked out."""
    return F.xxhash64(*of).bitwiseAND(F.lit((1 << 63) - 1)) if dict(table.dtypes)[column] == "bigint" else F.md5(F.concat_ws("/", *of))


def dedupe_by_hash(incoming: DataFrame, registry: DataFrame, order: str = "document_id") -> DataFrame:
    """Incoming files (file_hash, document_id or null) with `document_id` and `known`: a known hash takes the id of its earliest
    record, over the caller's. The first file (by `order`) with a new hash keeps the caller's id, or gets one made of the hash;
    the files after it with that hash are known, and take its id."""
    first = registry.groupBy("file_hash").agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("known_id"))
    place = F.struct(F.col(order).isNull(), F.col(order), F.coalesce(F.col("document_id"), own_id(incoming, "document_id", F.col("file_hash"))))
    rows = incoming.withColumn("place", place)
    heads = rows.groupBy("file_hash").agg(F.min("place").alias("head")).join(first, "file_hash", "left")
    out = rows.join(heads, "file_hash")
    known = F.col("known_id").isNotNull() | (F.col("place") != F.col("head"))
    return out.withColumn("known", known).withColumn("document_id", F.coalesce(F.col("known_id"), F.col("head.col3"))).drop("known_id", "place", "head")


def workspace_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("workspace_id").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"), F.max("created_at").alias("updated_at"))


def file_facets(files: DataFrame, sensors: DataFrame) -> DataFrame:
    """Per workspace: sorted distinct file types and sensor types, and the totals."""
    f = files.groupBy("workspace_id").agg(F.sort_array(F.collect_set("file_type")).alias("file_types"), F.count("*").alias("total_files"))
    s = sensors.groupBy("workspace_id").agg(F.sort_array(F.collect_set("sensor_type")).alias("sensor_types"), F.count("*").alias("total_sensors"))
    none = F.array().cast("array<string>")
    out = f.join(s, "workspace_id", "full")
    return out.select("workspace_id", F.coalesce("file_types", none).alias("file_types"), F.coalesce("sensor_types", none).alias("sensor_types"), F.coalesce("total_files", F.lit(0)).alias("total_files"), F.coalesce("total_sensors", F.lit(0)).alias("total_sensors"))


def index_state_counts(files: DataFrame) -> DataFrame:
    """Per workspace: documents (pdf, docx) that are done, and those neither done nor failed."""
    docs = files.where(F.col("file_type").isin("pdf", "docx"))
    status = F.coalesce("processing_status", F.lit("pending"))
    return docs.groupBy("workspace_id").agg(F.count_if(status == "done").alias("indexed"), F.count_if(~status.isin("done", "error")).alias("pending"))


def latest_status(events: DataFrame, key: str = "document_id") -> DataFrame:
    return events.groupBy(key).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def newest_first(table: DataFrame, workspace: str | None = None, key: str = "file_id") -> DataFrame:
    """list_files, list_workspaces, list_sensors, list_tags."""
    table = table if workspace is None else table.where(F.col("workspace_id") == workspace)
    return table.orderBy(F.desc("created_at"), key)


def list_documents(registry: DataFrame, status: str | None = None) -> DataFrame:
    registry = registry if status is None else registry.where(F.col("status") == status)
    return registry.orderBy("created_at", "document_id")


def lookup(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return table.join(ids.select(key), key, "left_semi")


def sort_files(files: DataFrame, field: str = "date", desc: bool = True) -> DataFrame:
    column = {"name": F.lower("filename"), "type": F.col("file_type"), "date": F.coalesce("created_at", F.lit("1970-01-01").cast("date")), "size": F.col("file_size")}[field]
    return files.orderBy(column.desc() if desc else column.asc(), "file_id")


def rank_hits(hits: DataFrame, query_key: str, score: str, k: int, item: str, descending: bool = True) -> DataFrame:
    """The k best of each query, ties by item, with their rank from 1. Each task keeps its own k before rows are shuffled."""
    order = F.desc(score) if descending else F.asc(score)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(order, item))).where(F.col("rank") <= k)
