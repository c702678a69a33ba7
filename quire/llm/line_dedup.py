"""Line dedup: drop lines whose normalised form occurs in many documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WS_CHARS, broadcast_if_small, lower_ascii, staged

#: Rows of frequent-line hashes (16 bytes each) that may be broadcast; above it the join shuffles both sides.
BROADCAST_ROWS = 500_000


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, copies_once: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Split each text at newlines; drop every line whose key (ASCII-stripped, A-Z lower-cased, at least `min_chars` code
    points) is found in at least `min_docs` rows of `docs`.

    Returns id_col, n_lines, n_dropped (long), kept_text and the columns of `carry`. With copies_once, rows with equal texts
    count as one document, so that a text with many copies isn't emptied. Lines travel as two 64-bit hashes of the key; the hash pairs of a
    row are made distinct before the count, so a line counts once for each row. The join of lines with frequent keys is on
    the hash (adaptive execution splits a hot one) and only its hits are grouped by row and joined back to the texts.

    Null or empty text: one empty line, kept. Lines with an empty key are never dropped. A text that loses all its lines
    becomes "". Each row is a document of its own, also if its id is null or occurs twice; equal rows give equal results.
    An empty table gives no rows. Columns that `carry` does not name are ignored, so their names can't clash.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry]).alias("carried"))
    base = base.withColumn("th", F.xxhash64("text")).withColumn("th2", F.xxhash64(F.lit(1), "text"))
    keys = F.transform(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS))), lower_ascii)
    pair = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    lines = staged(base.select("id", "th", "th2", pair.alias("hs")))

    counted = lines.dropDuplicates(["th", "th2"]) if copies_once else lines
    own = counted.select(F.array_sort("hs").alias("s"))
    own = own.select(F.explode(F.filter("s", lambda x, i: x.isNotNull() & ((i == 0) | (x != F.get("s", i - 1))))).alias("h"))
    frequent = own.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    frequent = staged(frequent)

    places = lines.select("id", "th", "th2", F.posexplode("hs").alias("pos", "h")).where(F.col("h").isNotNull())
    places = places.select("id", "th", "th2", "pos", "h.h1", "h.h2").join(broadcast_if_small(frequent, frequent.count(), BROADCAST_ROWS), ["h1", "h2"])
    hits = places.groupBy(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), F.col("th2").alias("hit_th2")).agg(F.collect_set("pos").alias("gone"))

    out = base.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")) & (F.col("th2") == F.col("hit_th2")), "left")
    out = out.select("id", "text", "carried", "gone", F.split("text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return out.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"), *[F.col("carried")[c].alias(c) for c in carry])
