"""The reference tables (files, registry, sensors, chunks, words, ...) as views of the driver's tables, the same in Spark and in
DuckDB, and the registry of queries over them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "DATE '2024-01-01' + CAST({0} % 365 AS INT)"

#: Hebrew letters, and those that a word can only end with.
LETTERS, FINALS = "אבגדהוזחטיכלמנסעפצקרשת", "םןץףך"


def _hebrew(k: int) -> str:
    """SQL of the k-th word of a text made of part keys: Hebrew letters, of every third text turned round with a final letter in
    front; some words Latin, some with digits; the space before it, now and then two."""
    word = f"substring('{LETTERS * 2}', CAST((p_partkey * {k + 3} + {k * 5}) % 22 AS INT) + 1, CAST((p_partkey + {k}) % 4 AS INT) + 2)"
    final = f"CASE WHEN p_partkey % 3 = 0 AND (p_partkey + {k}) % 4 <> 1 THEN substring('{FINALS}', CAST((p_partkey + {k}) % 5 AS INT) + 1, 1) ELSE '' END"
    other = f"CASE WHEN p_partkey % 11 = {k} THEN 'abc' WHEN p_partkey % 13 = {k} THEN '1234' WHEN p_partkey % 17 < 4 THEN 'latin' ELSE concat({final}, {word}) END"
    return (f"CASE WHEN (p_partkey + {k}) % 5 = 0 THEN '  ' ELSE ' ' END, " if k else "") + other


#: Views that both engines read; {table} is one of the driver's.
COMMON = {
    "files": f"""SELECT doc_id AS file_id, source AS workspace_id,
        concat('Doc ', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.geojson' WHEN 3 THEN '.shp' WHEN 4 THEN '.txt' ELSE '.json' END) AS filename,
        CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'geojson' WHEN 3 THEN 'shapefile' WHEN 4 THEN 'pdf' ELSE 'geojson' END AS file_type,
        CASE WHEN doc_id % 12 = 4 THEN 'application/pdf' END AS content_type, n_chars AS file_size,
        CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'error' WHEN 3 THEN 'processing' END AS processing_status,
        {DAY.format('doc_id')} AS created_at FROM {{documents}}""",
    "registry": f"""SELECT doc_id AS document_id, md5(text) AS file_hash, concat('Doc ', CAST(doc_id AS STRING)) AS file_name,
        CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'chunked' WHEN 2 THEN 'indexed' ELSE 'error' END AS status,
        {DAY.format('doc_id')} AS created_at FROM {{documents}} WHERE doc_id % 7 <> 3""",  # the others are not registered yet, so that joins miss
    "incoming": "SELECT doc_id AS row_id, md5(text) AS file_hash, doc_id + 1000000000 AS document_id FROM {documents}",
    "sensors": f"""SELECT s_suppkey AS sensor_id, concat('src', CAST(s_suppkey % 25 AS STRING)) AS workspace_id, s_name AS name,
        CASE s_suppkey % 9 WHEN 0 THEN 'SMOKE' WHEN 1 THEN 'TEMPERATURE' WHEN 2 THEN 'MOTION' WHEN 3 THEN 'CAMERA' WHEN 4 THEN 'FLOOD' WHEN 5 THEN 'GAS' WHEN 6 THEN 'ACCESS_CONTROL' WHEN 7 THEN 'OTHER' ELSE 'unheard' END AS sensor_type,
        s_suppkey * 3 AS linked_file_id, {DAY.format('s_suppkey')} AS created_at FROM {{supplier}}""",
    "workspaces": f"""SELECT concat('src', CAST(n_nationkey AS STRING)) AS workspace_id, n_name AS name,
        CASE WHEN n_regionkey = 0 THEN NULL ELSE concat('region ', CAST(n_regionkey AS STRING)) END AS description, {DAY.format('n_nationkey')} AS created_at FROM {{nation}}""",
    "tags": f"""SELECT c_custkey AS tag_id, concat('src', CAST(c_nationkey AS STRING)) AS workspace_id, c_name AS label, {DAY.format('c_custkey')} AS created_at FROM {{customer}}""",
    "vectors": "SELECT vec_id AS chunk_id, label AS document_id, concat(' text ', CAST(vec_id AS STRING), ' ') AS text, embedding FROM {embeddings}",
    "words": """SELECT l_orderkey AS doc, CASE WHEN l_linenumber > 3 THEN 2 ELSE 1 END AS page, (l_partkey * 10000000 + l_suppkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS seq, concat(l_returnflag, CAST(l_partkey AS STRING)) AS text,
        10 + 100 * l_discount AS size, l_quantity AS top, l_quantity + 10 + 100 * l_discount AS bottom, 1000 * l_tax AS x0, 1000 * l_tax + 20 AS x1 FROM {lineitem}""",
    "tables": "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS page, 0.0 AS x0, 5.0 AS top, 50.0 AS x1, 40.0 AS bottom FROM {orders} WHERE o_orderstatus = 'F'",
    "ocr_words": """SELECT l_orderkey AS doc, CASE WHEN l_linenumber > 3 THEN 2 ELSE 1 END AS page, CAST(l_suppkey % 3 AS INT) AS block_num, 1 AS par_num, l_linenumber AS line_num, (l_partkey * 10000000 + l_suppkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS seq,
        CASE WHEN l_returnflag = 'A' THEN '  ' ELSE concat(l_returnflag, CAST(l_partkey AS STRING)) END AS text, l_quantity AS top, 10 + 100 * l_discount AS height FROM {lineitem}""",
    "hebrew": f"""SELECT p_partkey AS id, CAST(floor(p_partkey / 10.0) AS BIGINT) AS doc, CASE WHEN p_partkey % 10 > 6 THEN 2 ELSE 1 END AS page, p_partkey % 10 AS line, concat(CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE '' END, {', '.join(_hebrew(k) for k in range(7))}) AS text FROM {{part}}""",
    "uploads": """SELECT p_partkey AS id, p_name AS file_name, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'PK' WHEN 2 THEN ' %PDF-1.4' ELSE concat('%PDF-1.', p_name) END AS content,
        CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 3000000 END AS length FROM {part}""",
    "layers": """SELECT c_custkey AS layer_id, c_custkey AS file_id, concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[', CAST(c_custkey % 360 - 180 AS STRING), ',', CAST(c_custkey % 170 - 85 AS STRING),
        ',7]},"properties":{"fid":1,"name":"', c_name, '","segment":"', c_mktsegment, '"}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[', CAST(c_custkey % 90 AS STRING), ',1.5],[2,-', CAST(c_custkey % 45 AS STRING), ']]},"properties":{"label":"line","empty":""}}]}') AS geojson FROM {customer}""",
    "events_status": """SELECT event_id, user_id AS document_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'ocr_completed' WHEN 'click' THEN 'chunked' WHEN 'purchase' THEN 'indexed' ELSE 'error' END AS status FROM {events}""",
    "questions": "SELECT conv_id * 1000 + turn AS query_id, text AS query, CAST(turn * 20 AS INT) AS top_k FROM {conversations} WHERE role = 'user'",
    "answers": "SELECT conv_id * 1000 + turn AS query_id, concat(text, ' Sources: ', CAST(turn AS STRING)) AS answer FROM {conversations} WHERE role = 'assistant'",
}

#: Views whose array functions differ: DuckDB's text; Spark's are methods of Views.
DUCK = {
    "chunks": "SELECT doc_id AS file_id, source AS workspace_id, unnest(range(len(l))) AS chunk_index, unnest(l) AS content FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents})",
    "blocks": """SELECT doc_id AS doc, i // 10 AS page, CAST(i % 10 AS INT) AS block, t AS text, CASE WHEN contains(t, ' | ') THEN 'table' ELSE 'text' END AS type, i * 10.0 AS y_top, i * 10.0 + 8 AS y_bottom, 10.0 AS font_size,
        CASE WHEN length(t) < 40 THEN 1.3 ELSE 1.0 END AS ratio_to_body, 1 AS line_count FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents}))""",
}


class Views:
    """The views over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in COMMON:
            raise AttributeError(name)
        used = set(re.findall(r"(?<![\w\"])\{(\w+)\}", COMMON[name]))
        text = COMMON[name]
        for t in used:  # not str.format(): GeoJSON has braces of its own
            self.table(t).createOrReplaceTempView(f"quire_{t}")
            text = text.replace(f"{{{t}}}", f"quire_{t}")
        return self.spark.sql(text)

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "t"))

    @property
    def chunks(self) -> DataFrame:
        return self.lines.select(F.col("doc_id").alias("file_id"), F.col("source").alias("workspace_id"), F.col("i").cast("long").alias("chunk_index"), F.col("t").alias("content"))

    @property
    def blocks(self) -> DataFrame:
        i = F.col("i")
        return self.lines.select(F.col("doc_id").alias("doc"), F.floor(i / 10).alias("page"), (i % 10).cast("int").alias("block"), F.col("t").alias("text"), F.when(F.contains("t", F.lit(" | ")), "table").otherwise("text").alias("type"),
            (i * 10.0).alias("y_top"), (i * 10.0 + 8).alias("y_bottom"), F.lit(10.0).alias("font_size"), F.when(F.char_length("t") < 40, 1.3).otherwise(1.0).alias("ratio_to_body"), F.lit(1).alias("line_count"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The views that the text names, and those that they name, before it."""
    every = {k: re.sub(r"(?<![\w\"])\{(\w+)\}", r"\1", v) for k, v in {**COMMON, **DUCK}.items()}
    used, todo = [], [sql]
    while todo:
        text = todo.pop()
        for k in every:
            if k not in used and re.search(rf"\b(?:FROM|JOIN)\s+{k}\b", text):
                used.append(k)
                todo.append(every[k])
    head = ", ".join(f"{k} AS ({every[k]})" for k in used)
    sql = sql.strip()
    if not head:
        return sql
    return f"WITH RECURSIVE {head}, {sql[len('WITH RECURSIVE '):]}" if sql.startswith("WITH RECURSIVE ") else f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Views under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[key] = with_views(sql)
        return f

    return register
