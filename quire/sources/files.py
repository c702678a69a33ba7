"""Reading and writing of files: raw bytes, JSON documents, registries, golden questions, GeoJSON, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.geo import extract_positions

MOST_BYTES = 100 * 1024 * 1024
BLOCK = "struct<text:string,type:string,y_top:double,y_bottom:double,font_size:double,ratio_to_body:double,line_count:int>"
PAGES = f"file_name string, pages array<struct<page_num:int,stats:struct<median_font_size:double,max_font_size:double>,blocks:array<{BLOCK}>>>"
CHUNKS = "chunk_id string, document_id string, page int, text string, metadata struct<document_id:string,page_num:int,block_id:int,is_header:boolean,block_type:string,extra:map<string,string>>"
RECORD = "struct<document_id:string,file_name:string,status:string,created_at:string,file_hash:string>"


def scan_raw_files(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", "length", "modificationTime", "content", F.sha2("content", 256).alias("file_hash"), F.element_at(F.split("path", "/"), -1).alias("file_name"))


#: Bytes of a line from which it counts as long, and of a file of texts.
LONG, FILE_BYTES = 1 << 16, 1 << 25


def write_texts(texts: DataFrame, path: str) -> None:
    """Texts (one column), one a line, in files of at most FILE_BYTES or of a single text, whatever the partitions. Long texts go to
    files of their own, so that a few of them don't make all files small. Null is the empty text."""
    rows = texts.select(F.coalesce(texts[0], F.lit("")).alias("text"))
    long = F.octet_length("text") > LONG
    for r in rows.groupBy(long.alias("long")).agg(F.max(F.octet_length("text")).alias("most")).collect():
        files = rows.where(long if r["long"] else ~long).write.mode("append")
        files.option("maxRecordsPerFile", max(1, FILE_BYTES // (r["most"] + 1))).text(path)


def validate_pdf(files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """reject_reason: the first check that fails, or null. Spark's readers skip empty files; those of expected(file_name) that
    were not read are rejected here as empty or missing, once however often they are listed."""
    if expected is not None:
        files = files.join(expected.select("file_name").distinct(), "file_name", "full")
    reason = F.coalesce(
        F.when(F.col("content").isNull(), "empty or missing"), F.when(F.col("length") == 0, "empty"), F.when(F.col("length") > MOST_BYTES, "too large"),
        F.when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "not a PDF"))
    return files.withColumn("reject_reason", reason)


def scan_ocr_json(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """One row per block: doc, page, block and the block's fields, of files that hold one document each (doc is the file's name) or
    with `lines` one a line (doc is its file_name). A file that doesn't fit fails the job."""
    docs = spark.read.schema(PAGES).option("multiLine", not lines).option("mode", "FAILFAST").json(glob)
    doc = F.col("file_name") if lines else F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    docs = docs.select(doc.alias("doc"), F.explode("pages").alias("p"))
    return docs.select("doc", F.col("p.page_num").alias("page"), "p.stats", F.posexplode("p.blocks").alias("block", "b")).select("doc", "page", "block", "b.*", "stats")


def scan_chunks_json(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """Chunks of files that hold one array each, or with `lines` one chunk a line; a file that doesn't fit fails the job."""
    return spark.read.schema(CHUNKS).option("multiLine", not lines).option("mode", "FAILFAST").json(glob)


def scan_registry_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per record of files that hold one map of records each, or with `lines` one map a line."""
    whole = spark.read.text(path, wholetext=not lines)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{RECORD}>")).alias("key", "r"))
    return rows.select(F.coalesce("r.document_id", "key").alias("document_id"), "r.file_name", "r.status", F.try_to_timestamp("r.created_at").alias("created_at"), "r.file_hash")


def scan_golden(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Both shapes of golden questions in one schema, of files that hold one array each or with `lines` one question a line."""
    schema = "id string, metric_focus string, question string, expected_pages array<int>, ground_truth string, query string, query_type string, expected_doc_id string, expected_page int"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    pages = F.coalesce("expected_pages", F.when(F.col("expected_page").isNotNull(), F.array("expected_page")))
    return rows.select("id", F.coalesce("question", "query").alias("question"), "metric_focus", "query_type", pages.alias("expected_pages"), "expected_doc_id", "ground_truth")


def scan_geojson(files: DataFrame, column: str = "geojson") -> DataFrame:
    """One row per feature of a FeatureCollection, Feature or bare geometry: feature_idx, geometry, properties (JSON text),
    positions, crs; the other columns stay."""
    c = F.col(column)
    kind = F.get_json_object(c, "$.type")
    feature = "struct<geometry:string,properties:string>"
    one = F.array(F.struct(F.get_json_object(c, "$.geometry").alias("geometry"), F.get_json_object(c, "$.properties").alias("properties")))
    bare = F.array(F.struct(c.alias("geometry"), F.lit("{}").alias("properties")))
    many = F.from_json(F.get_json_object(c, "$.features"), f"array<{feature}>")
    features = F.when(kind == "FeatureCollection", many).when(kind == "Feature", one).when(kind.isNotNull(), bare)
    rest = [x for x in files.columns if x != column]
    rows = files.select(*rest, F.posexplode(features).alias("feature_idx", "f")).select(*rest, "feature_idx", "f.*")
    return rows.withColumn("positions", extract_positions(F.col("geometry"))).withColumn("crs", F.lit("EPSG:4326"))


#: Buckets of a JSON table, which a reader has to know.
BUCKETS = 256


def bucket_of(column: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def write_json(df: DataFrame, path: str, by: str = "document_id", buckets: int = BUCKETS) -> None:
    """Rows as JSON in at most `buckets` folders, by the hash of their document, which lies together and in order; a bucket with many
    rows is written by several tasks."""
    rows = df.withColumn("bucket", bucket_of(F.col(by), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", by)
    rows.write.partitionBy("bucket").mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, ids: list | None = None, by: str = "document_id", buckets: int = BUCKETS) -> DataFrame:
    """What write_json() wrote; with ids, the rows of these documents, from their buckets alone."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).json(path)
    if ids is not None:
        kind = schema[by].dataType
        places = spark.createDataFrame([(x,) for x in ids], T.StructType([T.StructField("id", kind)])).select(bucket_of(F.col("id"), buckets))
        rows = rows.where(F.col("bucket").isin([r[0] for r in places.distinct().collect()]) & F.col(by).isin(ids))
    return rows.select(*schema.fieldNames())


def write_eval_csv(df: DataFrame, path: str) -> None:
    """With a header; arrays as JSON text."""
    df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def parse_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """ISO texts as timestamps; null where they aren't any."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as timestamp_ntz)") for c in columns})
