"""Benchmark decontamination: a positional inverted index of the training texts. DataFrame functions only.

The index has a posting (row, position) for every token of the training texts that is a term of some test item. Of each window
of an item's words the rarest terms are looked up; their postings, less the terms' places in the item, say where the item would
begin in a row. Where the lists of a window's rarest terms meet, the row's own words are compared with the item's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, lower_ascii, scratch, staged

#: Characters that separate words, once A-Z are lower-cased: all of ASCII but digits and a-z.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: The same before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASELESS = "".join(c for c in SEPARATORS if not c.isalpha())
#: Rows of terms, of places to look up or of rows that hit, at most 50 bytes each, that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def words_of(text: Column, lower: bool) -> Column:
    """Words of a text in order; with lower, A-Z lower-cased, else as they stand. No words: an empty array."""
    trimmed = F.btrim(text, F.lit(CASELESS))
    words = F.split(lower_ascii(trimmed) if lower else trimmed, GAP, -1)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(words)


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(CASELESS))
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(GAP)) + 1).cast("long")


def term_of(word: Column) -> Column:
    """The index's term of a word: it joins somewhat more than equal words (other letters' case), and hashes them."""
    return F.xxhash64(F.lower(word))


def positional_index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """k1, k2 (of a row), pos, term: every token of docs(k1, k2, text) that is one of terms(term)."""
    tokens = docs.select("k1", "k2", F.posexplode(words_of(F.col("text"), False)).alias("pos", "word")).select("k1", "k2", "pos", term_of(F.col("word")).alias("term"))
    return tokens.join(broadcast_if_small(terms, n_terms, BROADCAST_ROWS), "term").select("k1", "k2", "pos", "term")


def rarest_places(items: DataFrame, index: DataFrame, rarest: int) -> DataFrame:
    """term, item, p, which, o, need: for each window of items(item, words, n, width) all of whose terms occur in the index, the places o
    (and terms) of its `rarest` terms, numbered by `which`. Windows with the same places are one, number p of its item."""
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    places = items.select("item", F.posexplode("words").alias("o", "word")).select("item", "o", term_of(F.col("word")).alias("term"))
    places = places.join(counts, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("o", F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("places"))
    places = places.select("item", F.transform("places", lambda p: F.struct(p["df"].alias("df"), p["o"].alias("o"), p["term"].alias("term"))).alias("places"))
    rarest_of = lambda j: F.slice(F.array_sort(F.slice("places", j, F.col("width"))), 1, rarest)
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("width") + 1), rarest_of)
    in_order = lambda w: F.array_sort(F.transform(w, lambda x: F.struct(x["o"].alias("o"), x["term"].alias("term"))))
    found = F.array_distinct(F.transform(F.filter(windows, lambda w: w[0]["df"] > 0), in_order))
    rows = items.select("item", "n", "width").join(places, "item").select("item", F.posexplode(found).alias("p", "w"))
    return rows.select("item", "p", F.size("w").alias("need"), F.posexplode("w").alias("which", "x")).select("x.term", "item", "p", "which", "x.o", "need")


def meeting(index: DataFrame, places: DataFrame, n_places: int, rarest: int, slop: int) -> DataFrame:
    """k1, k2, item, starts: where the offset-adjusted lists of a window's rarest terms meet in a row, to within `slop` words.
    starts: where they meet exactly, so that the item would begin there; may be empty.

    An adjusted posting goes to two spans of 2 * (slop + 1) positions, so that all that lie within `slop` share one. What a span
    holds are bits, a position of a list each; so lists are merged in the tasks that read them."""
    s = slop + 1
    lists = index.join(broadcast_if_small(places, n_places, BROADCAST_ROWS), "term").select("k1", "k2", "item", "p", "which", "need", (F.col("pos") - F.col("o")).cast("long").alias("d"))
    home = F.floor(F.col("d") / s)
    lists = lists.select("k1", "k2", "item", "p", "which", "need", "d", F.explode(F.array(home, home - 1)).alias("span"))
    bit = F.expr(f"shiftleft(1L, CAST(which * {2 * s} + d - span * {s} AS INT))")
    spans = lists.groupBy("k1", "k2", "item", "p", "span").agg(F.bit_or(bit).alias("bits"), F.max("need").alias("need"))

    def all_lists(first: int, width: int) -> Column:
        """Whether each of the window's lists has a position among `width` of the span."""
        has = lambda w: F.col("bits").bitwiseAND(F.lit((1 << width) - 1 << 2 * s * w + first)) != 0
        out = has(0)
        for w in range(1, rarest):
            out = out & ((F.col("need") <= w) | has(w))
        return out

    near = all_lists(0, s)
    for x in range(1, s):
        near = near | all_lists(x, s)
    starts = F.array_compact(F.array(*[F.when(all_lists(x, 1), F.col("span") * s + x) for x in range(s)]))
    return spans.where(near).select("k1", "k2", "item", starts.alias("starts"))


def exact_runs(words: Column, place: Column) -> Column:
    """Runs [begin, end) of the row's words, `width` or longer, that are as the item's words at place(d, words, width)."""
    skip = F.greatest(F.lit(0).cast("long"), -place["d"])
    n = F.size(place["words"]) - skip
    equal = F.zip_with(F.slice(words, (place["d"] + skip + 1).cast("int"), n.cast("int")), F.slice(place["words"], (skip + 1).cast("int"), n.cast("int")), lambda a, b: a.eqNullSafe(b))
    unlike = F.filter(F.transform(equal, lambda e, i: F.when(~e, i.cast("long"))), lambda i: i.isNotNull())
    # between two that are unlike lies a run
    pairs = lambda c, z: F.zip_with(c, z, lambda a, b: F.struct((a + place["d"] + skip).alias("begin"), (b + place["d"] + skip).alias("end")))
    runs = pairs(F.concat(F.array(F.lit(0).cast("long")), F.transform(unlike, lambda i: i + 1)), F.concat(unlike, F.array(n)))
    return F.filter(runs, lambda r: r["end"] - r["begin"] >= place["width"])


def covered(runs: Column) -> Column:
    """How many positions lie in the union of runs [begin, end)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    more = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["begin"], a["upto"]))).alias("n"), F.greatest(r["end"], a["upto"]).alias("upto"))
    return F.aggregate(F.array_sort(runs), zero, more, lambda a: a["n"])


def compared(base: DataFrame, met: DataFrame, items: DataFrame) -> DataFrame:
    """k1, k2, n_hit, items (those with an exact window) of the rows in which lists meet exactly, by their own words. Texts of no
    other rows are moved."""
    places = met.select("k1", "k2", "item", F.explode("starts").alias("d")).distinct().join(items.select("item", "words", "width"), "item")
    places = staged(places.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "d", "words", "width")).alias("places")))
    keys = broadcast_if_small(places.select("k1", "k2"), places.count(), BROADCAST_ROWS)
    rows = base.join(keys, ["k1", "k2"], "left_semi").select("k1", "k2", words_of(F.col("text"), True).alias("own")).dropDuplicates(["k1", "k2"])
    found = rows.join(places, ["k1", "k2"]).select("k1", "k2", F.filter(F.transform("places", lambda p: F.struct(p["item"].alias("item"), exact_runs(F.col("own"), p).alias("runs"))), lambda x: F.size(x["runs"]) > 0).alias("found"))
    found = staged(found)
    return found.select("k1", "k2", covered(F.flatten(F.transform("found", lambda x: x["runs"]))).alias("n_hit"), F.array_distinct(F.transform("found", lambda x: x["item"])).alias("items"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, rarest: int = 2, slop: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For every row of docs: id_col, n_words, n_hit (words inside an exact occurrence of a window), n_items, items (sorted
    texts of the ids of the items with such windows), n_near (further items, of which only a proximity match is found).

    Words: runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window: `window` consecutive words of an item;
    all of an item that has fewer. Proximity: the `rarest` terms of a window (whatever their case), each within `slop` words of
    where the others' places would have it.

    Items with the same words are looked up once. Null and empty texts have no words; an item without any has no window. Null item
    ids count as the empty text; ids that are repeated count once. Each row of docs is a document of its own, also if its id is null or
    repeated; equal rows have equal results. No docs: no rows. Other columns are ignored."""
    if rarest * 2 * (slop + 1) > 62:
        raise ValueError("rarest * (slop + 1) may be 31 at most")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(1), "id", "text").alias("k2"))
    with scratch(spark):
        asked = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words_of(F.coalesce(F.col(item_text_col), F.lit("")), True).alias("words")).where(F.size("words") > 0)
        asked = staged(asked.groupBy("words").agg(F.collect_set("item_id").alias("ids")).withColumn("item", F.monotonically_increasing_id()))
        items = asked.select("item", "words", F.size("words").alias("n")).withColumn("width", F.least("n", F.lit(window)))
        terms = staged(items.select(F.explode("words").alias("word")).select(term_of(F.col("word")).alias("term")).distinct())
        index = staged(positional_index(base, terms, terms.count()))
        places = staged(rarest_places(items, index, rarest))
        met = staged(meeting(index, places, places.count(), rarest, slop))
        exact = staged(compared(base, met, items))
        both = met.select("k1", "k2", "item", F.lit(False).alias("exact")).distinct().union(exact.select("k1", "k2", F.explode("items"), F.lit(True)))
        ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        named = both.join(asked.select("item", "ids"), "item").groupBy("k1", "k2").agg(ids(F.when(F.col("exact"), F.col("ids"))).alias("items"), ids("ids").alias("all_items"))
        named = named.select("k1", "k2", "items", F.size(F.array_except("all_items", "items")).cast("long").alias("n_near"))
        found = staged(named.join(exact.select("k1", "k2", "n_hit"), ["k1", "k2"], "left"), keep=True)
    zero = F.lit(0).cast("long")
    out = base.select("id", "k1", "k2", n_words(F.col("text")).alias("n_words")).join(found, ["k1", "k2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("n_near", zero).alias("n_near"))
