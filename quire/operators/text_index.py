"""Text indexes: postings of words, scored by BM25, and postings of three-byte grams, for substrings of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.catalog import rank_hits
from quire.sources.staging import brief_shuffles, file_system, staged

# Saturation of a term's count, share of a text's length.
K1, B = 1.2, 0.75
#: Rows (at most 50 bytes each) that may be broadcast; beyond it joins shuffle, the postings of a term dealt to SALT tasks.
BROADCAST_ROWS, SALT = 500_000, 16
#: Postings of each query's rarest terms that are scored first, for a bound on what is worth scoring.
SEED_POSTINGS = 20_000
#: Times k texts of a query that are scored in full for that bound.
TRIED = 5
#: Share of the bound that a query's frequent words may reach together, if texts are not to be brought up by them: less than one, so
#: that a text needs a good part of the bound from its other words, and few do.
HALF = 0.5
#: Slices of the texts in which many candidates are scored, one after the other: what is shuffled at once is that part of the postings.
SLICES = 4
META = "buckets int, kind string"
#: Bytes of text whose grams are gathered at once; grams of a pattern that are looked up.
GRAM_BYTES, RAREST = 1 << 22, 3


def terms_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def counted(terms: Column) -> Column:
    """term, tf of each distinct word of a list. Lists are bound by one-element arrays, so that they are worked out once."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    places = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf")))
    return F.when(F.size(terms) > 0, once(F.sort_array(terms), lambda s: once(places(s), lambda at: runs(s, at))))


class TextIndex:
    """An inverted index of words below a folder: `postings` (term, id, tf, length; a folder for each bucket of terms) and `texts`
    (id, length)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self, terms: DataFrame) -> DataFrame:
        """Postings of the buckets that terms(term) fall into; other folders are not read. The buckets, as many as the index has
        at most, come to the driver."""
        meta = self.spark.read.schema(META).json(f"{self.path}/meta").first()
        rows = self.spark.read.schema(f"term string, id {meta['kind']}, tf int, length int, bucket int").parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin([r[0] for r in terms.select(bucket_of("term", meta["buckets"])).distinct().collect()]))


def bucket_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias("bucket")


def add_to_index(texts: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", buckets: int = 64) -> TextIndex:
    """Index texts below `path`, beside those that it has already (which keeps its number of buckets). Ids should be new ones; rows
    that share an id are one text as to its words, as long as the longest of them. Rows without an id are left out. A null
    text has no words. Where no rows share an id nothing but ids is shuffled: each task counts its own texts' words and writes its
    part of every bucket. A bucket with many postings is written by several tasks."""
    spark = texts.sparkSession
    fs, meta = file_system(spark, f"{path}/meta")
    if fs.exists(meta):
        buckets = spark.read.schema(META).json(f"{path}/meta").first()["buckets"]
    else:
        spark.createDataFrame([(buckets, dict(texts.dtypes)[id_col])], META).coalesce(1).write.json(f"{path}/meta")
    rows = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), terms_of(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    sizes = staged(rows.groupBy("id").agg(F.max(F.size("terms")).alias("length"), F.count("*").alias("rows")))
    sizes.select("id", "length").write.mode("append").parquet(f"{path}/texts")
    if sizes.where("rows > 1").isEmpty():
        postings = rows.select("id", F.size("terms").alias("length"), F.explode(counted(F.col("terms"))).alias("t")).select("t.term", "id", "t.tf", "length", bucket_of("t.term", buckets))
    else:
        tokens = rows.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
        postings = tokens.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.max("length").alias("length"))
        postings = postings.withColumn("bucket", bucket_of("term", buckets)).hint("rebalance", "bucket")
    with brief_shuffles(spark):  # sorted ids differ in their ends, of which the second version of Parquet's pages keeps little more
        files = postings.sortWithinPartitions("bucket", "term", "id").write.mode("append").partitionBy("bucket")
        files.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{path}/postings")
    return TextIndex(spark, path)


def meet(postings: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Postings joined with what is asked of them. Few asked rows are broadcast; else a term's postings are dealt to SALT tasks."""
    if asked.count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(asked), keys)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt")
    asked = asked.select("*", salt) if "id" in keys else asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    return postings.select("*", salt).join(asked, [*keys, "salt"]).drop("salt")


class Bm25:
    """The words of some queries with their weights in an index (idf) and the most that they add to any text's score (most)."""

    def __init__(self, queries: DataFrame, index: TextIndex, query_id: str, text: str):
        size = index.texts.agg(F.count("*").alias("n"), F.avg("length").alias("length")).first()
        self.n, self.length = size["n"], size["length"] or 1.0
        words = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term"))
        distinct = staged(words.select("term").distinct())
        self.postings = index.postings(distinct)
        df = meet(self.postings, distinct, ["term"]).groupBy("term").agg(F.count("*").alias("df"), F.max(self.share()).alias("most"))
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.words = staged(words.join(df, "term").withColumn("idf", idf).withColumn("most", F.col("most") * idf))

    def share(self) -> Column:
        """What one term adds to a text's score, in parts of the term's weight."""
        return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / self.length))

    def sums(self, words: DataFrame, keys: list[str]) -> DataFrame:
        """query_id, id, score: the gains of words(query_id, term, idf, and id if it is a key) summed."""
        rows = meet(self.postings, words.select("query_id", "idf", *keys), keys)
        return rows.groupBy("query_id", "id").agg(F.sum(F.col("idf") * self.share()).alias("score"))


def rounded(score: str = "score") -> Column:
    """To nine digits, so that texts with equal words tie in whatever order their gains were summed."""
    return F.round(score, 9).alias("score")


def bm25_search(queries: DataFrame, index: TextIndex, k: int, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, id, score, rank: for every query the k texts with the greatest BM25 score (distinct query words; ties by id), exact, among
    those that share a word with it.

    The texts that score best by the rarest words alone, up to SEED_POSTINGS of them, are scored by all words: that gives each query
    a score that its k-th text is sure to reach. Words that can't reach a share of it even together (the frequent ones, whose gains are small) don't make a text a candidate:
    their postings are only read for the texts that the other words have brought near enough to the bound."""
    bm25 = Bm25(queries, index, query_id, text)
    if bm25.words.isEmpty():
        return rank_hits(bm25.sums(bm25.words, ["term"]), "query_id", "score", k, "id")
    by_query = Window.partitionBy("query_id")
    before = F.sum("df").over(by_query.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    seeds = bm25.words.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("df") <= SEED_POSTINGS))
    first = rank_hits(bm25.sums(seeds, ["term"]), "query_id", "score", TRIED * k, "id").select("query_id", "id")
    first = staged(first.join(bm25.words.select("query_id", "term", "idf"), "query_id"))
    best = rank_hits(bm25.sums(first, ["term", "id"]), "query_id", "score", k, "id").where(F.col("rank") == k).select("query_id", (F.col("score") * (1 - 1e-9)).alias("sure"))
    reach = F.sum("most").over(by_query.orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, 0))
    words = bm25.words.join(best, "query_id", "left").withColumns({"sure": F.coalesce("sure", F.lit(0.0)), "reach": reach})
    words = staged(words.withColumn("brings", F.col("reach") >= HALF * F.col("sure")))
    part = bm25.sums(words.where("brings"), ["term"])
    rest = words.where("not brings").groupBy("query_id").agg(F.max("sure").alias("sure"), F.max("reach").alias("reach"), F.collect_list(F.struct("term", "idf")).alias("words"))
    part = part.join(rest, "query_id", "left").where(F.col("words").isNull() | (F.col("score") + F.col("reach") >= F.col("sure")))
    part = staged(part)
    more = bm25.sums(part.select("query_id", "id", F.inline("words")), ["term", "id"]).withColumnRenamed("score", "more")
    out = part.join(more, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return rank_hits(out.select("query_id", "id", rounded()), "query_id", "score", k, "id")


def bm25_scores(candidates: DataFrame, queries: DataFrame, index: TextIndex, item: str = "chunk_id", query_id: str = "query_id", text: str = "query") -> DataFrame:
    """candidates(query_id, item, ...) with `bm25`: the score of each row's pair, 0 without a shared word. Of few candidates the
    postings of their own words are summed. Of many, the postings of all words asked are dealt by text and meet the candidates there,
    slice by slice; pairs and words are never multiplied out on disk."""
    bm25, candidates = Bm25(queries, index, query_id, text), staged(candidates)
    pairs = candidates.select(F.col(query_id).alias("query_id"), F.col(item).alias("id"))
    words = bm25.words.select("query_id", "term", "idf")
    asked = pairs.groupBy("query_id").count().join(words.groupBy("query_id").agg(F.count("*").alias("words")), "query_id").agg(F.sum(F.col("count") * F.col("words"))).first()[0]
    if (asked or 0) <= BROADCAST_ROWS:
        scores = bm25.sums(pairs.distinct().join(words, "query_id"), ["term", "id"])
        scores = scores.select(F.col("query_id").alias(query_id), F.col("id").alias(item), rounded().alias("bm25"))
        return candidates.join(scores, [query_id, item], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    few = F.broadcast if words.count() <= BROADCAST_ROWS else lambda df: df
    gains = bm25.postings.join(few(words.select("term").distinct()), "term", "left_semi").select("id", "term", "tf", "length")
    rows = candidates.select(F.struct("*").alias("row"), F.col(query_id).alias("query_id"), F.col(item).alias("id"), F.monotonically_increasing_id().alias("place"))
    # A row that goes along as a part of the key is summed by hash, by first() its copies would be sorted; a map can't be a key.
    keys, kept = (["id", "place"], [F.first("row").alias("row")]) if "map<" in str(dict(rows.dtypes)["row"]) else (["id", "place", "row"], [])
    out = None
    for k in range(SLICES):
        own = F.pmod(F.xxhash64("id"), F.lit(SLICES)) == k
        met = rows.where(F.coalesce(own, F.lit(k == 0))).join(gains.where(own), "id", "left").join(few(words), ["query_id", "term"], "left")
        scores = met.groupBy(*keys).agg(*kept, F.coalesce(F.sum(F.col("idf") * bm25.share()), F.lit(0.0)).alias("score"))
        scores = staged(scores.select("row.*", rounded().alias("bm25")))
        out = scores if out is None else out.unionByName(scores)
    return out


# ---- substrings ----------------------------------------------------------------------------------------------------------


def grams_of(data: np.ndarray) -> np.ndarray:
    """Of every byte the number of it and the two after it; two bytes 0 follow the text, so that each byte begins one."""
    b = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def gram_postings(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """gram, ids: texts(id, text) by those of their grams that are wanted (of all 2^24), a list for each gram and stretch of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # 2 MiB, whatever the data

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            text, first = b.column("text").cast(pa.large_binary()), 0
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + b.num_rows + 1]
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + GRAM_BYTES, side="right")) - 1)
                size = np.diff(ends[first : last + 1])
                data = np.frombuffer(text.buffers()[2], np.uint8)[ends[first] : ends[last]] if ends[last] > ends[first] else np.zeros(0, np.uint8)
                row = np.repeat(np.arange(len(size)), size)
                gram = grams_of(data)
                for back in (1, 2):  # grams do not reach into the next text
                    at = np.cumsum(size)[size >= back] - back
                    gram[at] &= ~0xFF if back == 2 else ~0xFFFF
                mask = keep[gram]
                both = np.unique(gram[mask].astype(np.int64) << 32 | row[mask])
                gram = both >> 32
                begin = np.flatnonzero(np.diff(gram, prepend=-1))
                ids = b.column("id").slice(first, len(size)).take(pa.array(both & 0xFFFFFFFF))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(both)).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([pa.array(gram[begin].astype(np.int32)), lists], names=["gram", "ids"])
                first = last

    return texts.mapInArrow(post, f"gram int, ids array<{dict(texts.dtypes)['id']}>")


def texts_with(texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern_id: str = "item_id", pattern_col: str = "text") -> DataFrame:
    """pattern_id, id_col of every text that holds a pattern, sign by sign, wherever it stands. Rows that share an id are looked
    through each; null texts and null or empty patterns are left out.

    Texts are listed by those grams that occur in a pattern; a pattern is looked up by its RAREST rarest grams, one of less than
    three bytes by all grams that begin with it; texts on all lists are then searched for the pattern itself. Grams that occur in
    patterns, at most 2^24, come to the driver."""
    p = patterns.where(F.octet_length(F.col(pattern_col)) > 0).select(F.col(pattern_id).alias("pattern_id"), F.col(pattern_col).alias("pattern"))
    p = staged(p.withColumn("hex", F.hex(F.encode("pattern", "UTF-8"))).withColumn("n", F.octet_length("pattern")))
    code = lambda h: F.conv(h, 16, 10).cast("int")
    long = p.where("n >= 3").select("pattern_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.substring(F.col("hex"), i * 2 + 1, F.lit(6))))).alias("h"))
    long = staged(long.select("pattern_id", code(F.col("h")).alias("gram")))
    short = p.where("n < 3").select("pattern_id", "n", code(F.col("hex")).alias("head"))
    wanted = np.zeros(1 << 24, bool)
    for part in long.select("gram").distinct().toArrow().to_batches():
        wanted[part.column("gram").to_numpy()] = True
    for r in short.select("n", "head").distinct().collect():  # at most 2^16 and 2^8
        width = 1 << 8 * (3 - r["n"])
        wanted[r["head"] * width : (r["head"] + 1) * width] = True
    base = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    postings = staged(gram_postings(base, wanted))
    sizes = staged(postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("df")))  # at most 2^24 rows
    place = F.row_number().over(Window.partitionBy("pattern_id").orderBy("df", "gram"))
    ranked = long.join(sizes, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("which", place).where(F.col("which") <= RAREST)
    chosen = ranked.select("pattern_id", "gram", "which", F.count("*").over(Window.partitionBy("pattern_id")).alias("need"))
    for n in (1, 2):
        begins = short.where(F.col("n") == n).join(sizes.withColumn("head", F.shiftright("gram", 8 * (3 - n))), "head")
        chosen = chosen.unionByName(begins.select("pattern_id", "gram", F.lit(1).alias("which"), F.lit(1).cast("long").alias("need")))
    chosen = staged(chosen)
    asked = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    hits = postings.join(asked, "gram").select("pattern_id", "which", "need", F.explode("ids").alias("id"))
    pairs = hits.groupBy("pattern_id", "id").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, which)"))).alias("has"), F.max("need").alias("need"))
    pairs = staged(pairs.where(F.col("has") == F.col("need")).select("pattern_id", "id"))
    found = pairs.join(p.select("pattern_id", "pattern"), "pattern_id").groupBy("id").agg(F.collect_list(F.struct("pattern_id", "pattern")).alias("patterns"))
    found = staged(found)
    ids = found.select("id")
    rows = base.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi").join(found, "id")  # other texts are not moved
    held = F.transform(F.filter("patterns", lambda x: F.contains("text", x["pattern"])), lambda x: x["pattern_id"])
    return rows.select(F.explode(held).alias(pattern_id), F.col("id").alias(id_col)).distinct()
