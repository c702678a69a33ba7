"""Queries over files, workspaces, sensors and registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog as C
from quire.plans.fixtures import query

KIND = "CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.docx' THEN 'docx' WHEN lower(filename) LIKE '%.geojson' OR lower(filename) LIKE '%.json' THEN 'geojson' WHEN lower(filename) LIKE '%.shp' OR lower(filename) LIKE '%.shapefile' THEN 'shapefile' ELSE 'pdf' END"


@query(f"SELECT file_id, {KIND} AS kind FROM files")
def classify_file_type(v):
    return v.files.select("file_id", T.classify_file_type(F.col("filename")).alias("kind"))


@query("""SELECT file_id, filename, coalesce(content_type IN ('application/pdf'), false)
  OR list_contains(['pdf', 'docx', 'geojson', 'json', 'shp', 'shapefile', 'dbf', 'shx', 'prj'], lower(regexp_extract(filename, '[^.]*$'))) AS accepted FROM files""")
def accept_upload(v):
    ok, rejected = C.accept_upload(v.files)
    return ok.select("file_id", "filename", F.lit(True).alias("accepted")).union(rejected.select("file_id", "filename", F.lit(False)))


@query(f"SELECT file_id, CASE {KIND} WHEN 'pdf' THEN 'document' WHEN 'docx' THEN 'text' WHEN 'geojson' THEN 'layer' ELSE 'none' END AS route FROM files")
def route_upload(v):
    return C.route_upload(v.files).select("file_id", "route")


@query("SELECT file_id, workspace_id || '/' || CAST(file_id AS VARCHAR) || '/' || filename AS object_key FROM files")
def object_key(v):
    return v.files.select("file_id", T.object_key(F.col("workspace_id"), F.col("file_id").cast("string"), F.col("filename")).alias("object_key"))


@query("SELECT file_id, filename, file_type FROM files WHERE contains(lower(filename), 'doc 1') AND file_type IN ('pdf', 'docx')")
def files_filter(v):
    return C.files_filter(v.files, "Doc 1", ["pdf", "docx"]).select("file_id", "filename", "file_type")


@query("SELECT workspace_id, name FROM workspaces WHERE contains(lower(name), '1') OR coalesce(contains(lower(description), '1'), false)")
def workspaces_filter(v):
    return C.workspaces_filter(v.workspaces, "1").select("workspace_id", "name")


@query("SELECT score, CASE WHEN score >= 80 THEN 'success' WHEN score >= 50 THEN 'warning' ELSE 'destructive' END AS band FROM (SELECT p_size * 2 AS score FROM part)")
def score_band(v):
    return v.table("part").select((F.col("p_size") * 2).alias("score")).withColumn("band", T.score_band(F.col("score")))


@query("""SELECT file_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576.0, 1))
  ELSE printf('%.1f GB', round(n / 1073741824.0, 1)) END AS label FROM (SELECT file_id, file_size * file_size AS n FROM files)""")
def file_size_label(v):
    return v.files.select("file_id", T.file_size_label(F.col("file_size") * F.col("file_size")).alias("label"))


@query("SELECT o_orderkey, TRY_CAST(t AS TIMESTAMP) AS t FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'no date' ELSE '2024-02-03 04:05:06' END AS t FROM orders)")
def parse_timestamps(v):
    from quire.sources.files import parse_timestamps as parse

    rows = v.table("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "no date").otherwise("2024-02-03 04:05:06").alias("t"))
    return parse(rows, ["t"])


@query("SELECT c.file_id, c.chunk_index, f.filename, f.workspace_id FROM chunks c JOIN files f ON c.file_id = f.file_id WHERE f.workspace_id = 'src1'")
def chunks_with_files(v):
    return C.chunks_with_files(v.chunks.drop("workspace_id"), v.files, "src1").select("file_id", "chunk_index", "filename", "workspace_id")


@query("SELECT l.layer_id, f.filename, f.workspace_id, length(l.geojson) AS n FROM layers l JOIN files f ON l.file_id = f.file_id")
def layers_with_files(v):
    return C.layers_with_files(v.layers, v.files).select("layer_id", "filename", "workspace_id", F.length("geojson").cast("long").alias("n"))


@query("""SELECT s.sensor_id, f.filename, coalesce(CASE sensor_type WHEN 'TEMPERATURE' THEN 'Temperature' WHEN 'MOTION' THEN 'Motion' WHEN 'CAMERA' THEN 'Camera' WHEN 'FLOOD' THEN 'Flood' WHEN 'GAS' THEN 'Gas'
  WHEN 'ACCESS_CONTROL' THEN 'Access control' WHEN 'OTHER' THEN 'Other' END, 'Smoke') AS type_label FROM sensors s LEFT JOIN files f ON s.linked_file_id = f.file_id""")
def sensors_with_files(v):
    return C.sensors_with_files(v.sensors, v.files).select("sensor_id", "filename", "type_label")


@query("SELECT file_id FROM files WHERE file_type IN ('pdf', 'docx')")
def linkable_files(v):
    return C.linkable_files(v.files).select("file_id")


@query("SELECT f.file_id, coalesce(CASE WHEN file_type = 'pdf' THEN coalesce(r.status, processing_status) ELSE processing_status END, 'unknown') AS status FROM files f LEFT JOIN registry r ON f.file_id = r.document_id")
def effective_status(v):
    return C.effective_status(v.files, v.registry).select("file_id", "status")


@query("""SELECT row_id, coalesce(k.document_id, min(i.document_id) OVER (PARTITION BY i.file_hash)) AS document_id, k.document_id IS NOT NULL OR i.document_id > min(i.document_id) OVER (PARTITION BY i.file_hash) AS known FROM incoming i
  LEFT JOIN (SELECT file_hash, document_id, row_number() OVER (PARTITION BY file_hash ORDER BY created_at, document_id) AS n FROM registry) k ON i.file_hash = k.file_hash AND k.n = 1""")
def dedupe_by_hash(v):
    return C.dedupe_by_hash(v.incoming, v.registry).select("row_id", "document_id", "known")


@query("SELECT workspace_id, count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS total_size, max(created_at) AS updated_at FROM files GROUP BY workspace_id")
def workspace_stats(v):
    return C.workspace_stats(v.files)


@query("""SELECT coalesce(f.workspace_id, s.workspace_id) AS workspace_id, coalesce(f.types, '') AS file_types, coalesce(s.types, '') AS sensor_types, coalesce(f.n, 0) AS total_files, coalesce(s.n, 0) AS total_sensors
  FROM (SELECT workspace_id, string_agg(DISTINCT file_type, ',' ORDER BY file_type) AS types, count(*) AS n FROM files GROUP BY workspace_id) f
  FULL JOIN (SELECT workspace_id, string_agg(DISTINCT sensor_type, ',' ORDER BY sensor_type) AS types, count(*) AS n FROM sensors GROUP BY workspace_id) s ON f.workspace_id = s.workspace_id""")
def file_facets(v):
    return C.file_facets(v.files, v.sensors).withColumns({c: F.array_join(c, ",") for c in ("file_types", "sensor_types")})


@query("""SELECT workspace_id, count(*) FILTER (WHERE coalesce(processing_status, 'pending') = 'done') AS indexed, count(*) FILTER (WHERE coalesce(processing_status, 'pending') NOT IN ('done', 'error')) AS pending
  FROM files WHERE file_type IN ('pdf', 'docx') GROUP BY workspace_id""")
def index_state_counts(v):
    return C.index_state_counts(v.files)


@query("SELECT document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS n FROM events_status) WHERE n = 1")
def latest_status(v):
    return C.latest_status(v.events_status)


for _name, _view, _key, _ws in (("list_files", "files", "file_id", None), ("list_workspaces", "workspaces", "workspace_id", None), ("list_sensors", "sensors", "sensor_id", "src1"), ("list_tags", "tags", "tag_id", "src1")):
    query(f"SELECT {_key}, created_at FROM {_view} {f'''WHERE workspace_id = '{_ws}' ''' if _ws else ''}ORDER BY created_at DESC, {_key}", name=_name)(
        lambda v, view=_view, key=_key, ws=_ws: C.newest_first(getattr(v, view), ws, key).select(key, "created_at"))


@query("SELECT document_id, created_at FROM registry WHERE status = 'indexed' ORDER BY created_at, document_id")
def list_documents(v):
    return C.list_documents(v.registry, "indexed").select("document_id", "created_at")


@query("SELECT file_id, filename FROM files WHERE file_id IN (SELECT linked_file_id FROM sensors)")
def lookup(v):
    return C.lookup(v.files, "file_id", v.sensors.select(F.col("linked_file_id").alias("file_id"))).select("file_id", "filename")


@query("SELECT file_id, file_size FROM files ORDER BY file_size DESC, file_id")
def sort_files(v):
    return C.sort_files(v.files, "size").select("file_id", "file_size")


@query("SELECT document_id, chunk_id, CAST(n AS INT) AS rank FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY embedding[1] DESC, chunk_id) AS n FROM vectors) WHERE n <= 3")
def rank_hits(v):
    return C.rank_hits(v.vectors.withColumn("s", F.get("embedding", F.lit(0))), "document_id", "s", 3, "chunk_id").select("document_id", "chunk_id", "rank")
