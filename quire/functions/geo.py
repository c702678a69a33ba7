"""GeoJSON held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property names that label a feature, in order.
LABELS = ["name", "NAME", "label", "LABEL", "title", "TITLE", "id", "ID"]
#: How many collections may lie inside each other.
DEPTH = 8


def extract_positions(geometry: Column, depth: int = DEPTH) -> Column:
    """All [lon, lat] of a geometry, of collections within collections too, by the depth of its kind's `coordinates`; further dimensions
    go, and so do positions of less than two numbers. Other members (`bbox`, foreign ones) are not looked at. Unknown kinds and
    coordinates of another depth, or with what isn't a number, give none; collections more than `depth` deep fail the job, so that none is lost unseen."""
    kind, raw = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    level = lambda n: F.from_json(raw, "array<" * n + "double" + ">" * n)
    none = F.array().cast("array<array<double>>")
    inner = F.from_json(F.get_json_object(geometry, "$.geometries"), "array<string>")
    below = F.flatten(F.transform(inner, lambda g: extract_positions(g, depth - 1))) if depth else F.when(F.size(inner) > 0, F.raise_error(F.lit("collections lie too deep in each other")).cast("array<array<double>>"))
    found = F.when(kind == "Point", F.array(level(1))).when(kind.isin("LineString", "MultiPoint"), level(2)).when(kind.isin("Polygon", "MultiLineString"), F.flatten(level(3)))
    found = found.when(kind == "MultiPolygon", F.flatten(F.flatten(level(4)))).when(kind == "GeometryCollection", below)
    whole = F.filter(F.coalesce(found, none), lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    return F.transform(whole, lambda p: F.slice(p, 1, 2))


def feature_label(properties: Column, fallback: Column) -> Column:
    return F.coalesce(*[F.get_json_object(properties, f"$.{k}") for k in LABELS], fallback)


def feature_properties(properties: Column, n: int = 8) -> tuple[Column, Column]:
    """The first n properties that are not empty, geometry nor fid, as an array of key and value; how many more there are."""
    entries = F.map_entries(F.map_filter(F.from_json(properties, "map<string,string>"), lambda k, v: ~k.isin("geometry", "fid") & v.isNotNull() & (v != "")))
    return F.slice(entries, 1, n), F.greatest(F.size(entries) - n, F.lit(0))
