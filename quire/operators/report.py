"""Readiness of workspaces: which sensor types their documents cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.catalog import file_facets, index_state_counts
from quire.operators.keywords import keyword_coverage


def readiness_items(files: DataFrame, sensors: DataFrame, chunks: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """workspace_id, place (order in the report), kind (covered, gap, warning), item: one row per finding."""
    facts = file_facets(files, sensors).join(index_state_counts(files), "workspace_id", "left")
    covered = keyword_coverage(chunks, keywords).where("covered").groupBy("workspace_id").agg(F.collect_set("sensor_type").alias("sop"))
    facts = facts.join(covered, "workspace_id", "left").withColumn("sop", F.coalesce("sop", F.array().cast("array<string>")))
    item = lambda place, kind, text, when: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), text.alias("item")))
    found = []
    for k, (t, words) in enumerate(keywords.items()):
        has, sop = F.array_contains("sensor_types", t), F.array_contains("sop", t)
        found.append(item(k, "covered", F.lit(f"{t}: sensor and procedure"), has & sop))
        found.append(item(k, "gap", F.lit(f"{t}: sensor without procedure; look for {', '.join(words[:3])}"), has & ~sop))
        found.append(item(k, "warning", F.lit(f"{t}: procedure without sensor"), ~has & sop))
    n = len(keywords)
    gis = F.exists("file_types", lambda t: t.isin("geojson", "shapefile"))
    indexed, pending = F.coalesce("indexed", F.lit(0)), F.coalesce("pending", F.lit(0))
    found += [
        item(n, "covered", F.lit("map data present"), gis), item(n, "gap", F.lit("no map data"), ~gis),
        item(n + 1, "covered", F.format_string("%d documents indexed", indexed), indexed > 0), item(n + 2, "warning", F.format_string("%d documents pending", pending), pending > 0),
        item(n + 3, "gap", F.lit("no files"), F.col("total_files") == 0), item(n + 4, "warning", F.lit("no sensors"), F.col("total_sensors") == 0),
    ]
    return facts.select("workspace_id", F.inline(F.array_compact(F.array(*found))))


def readiness_report(files: DataFrame, sensors: DataFrame, chunks: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Per workspace: ordered lists, score (half-even percentage of covered findings) and the facets."""
    items = readiness_items(files, sensors, chunks, keywords)
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "item")))), lambda x: x["item"]).alias(kind)
    lists = items.groupBy("workspace_id").agg(of("covered"), of("gap"), of("warning"))
    total = F.size("covered") + F.size("gap") + F.size("warning")
    score = F.when(total > 0, F.bround(100 * F.size("covered") / total)).otherwise(0).cast("int")
    return file_facets(files, sensors).join(lists, "workspace_id", "left").withColumn("score", F.coalesce(score, F.lit(0)))


def layer_bounds(features: DataFrame, by: str = "layer") -> DataFrame:
    """features (layer_id, feature_idx, positions) to min_lon, min_lat, max_lon, max_lat per layer or feature; null without
    positions; feature_count."""
    keys = ["layer_id"] if by == "layer" else ["layer_id", "feature_idx"]
    low = lambda i: F.array_min(F.transform("positions", lambda p: p[i]))
    high = lambda i: F.array_max(F.transform("positions", lambda p: p[i]))
    return features.groupBy(*keys).agg(F.min(low(0)).alias("min_lon"), F.min(low(1)).alias("min_lat"), F.max(high(0)).alias("max_lon"), F.max(high(1)).alias("max_lat"), F.count("*").alias("feature_count"))


def top_features(features: DataFrame, n: int = 12) -> DataFrame:
    return features.withColumn("place", F.row_number().over(Window.partitionBy("layer_id").orderBy("feature_idx"))).where(F.col("place") <= n)
