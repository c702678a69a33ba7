"""N-gram Jaccard join by chosen paths: near duplicates on word shingles.

Every text becomes the set of its shingles, and rows with the same set are one class of copies. A set is embedded as its
SKETCH minimum hashes ("tokens"); two sets share a token with the probability of their Jaccard similarity. A run samples a
token for the root and splits all sets by it; a bucket that is large and not dense is split again by tokens sampled for that
bucket, and so on; small buckets, and dense ones in blocks, are compared by brute force. Runs are repeated until a pair at
the threshold is missed with less than 1 - recall, by the filter on sketches or because it shares no bucket, even if all its
buckets are split as often as the most split one. Candidates are verified on their whole sets; each pair counts in the first
bucket that both sets reach, so that no list of pairs is ever written."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, scratch, staged
from quire.llm.lm_scoring import lowered, words_of
from quire.llm.words import WordIds

#: Minimum hashes of a set, and tokens sampled for a bucket that is split again.
SKETCH, TOKENS = 128, 2
#: Buckets of at most so many sets are compared whole. Dense ones are cut into blocks that are compared in pairs: DENSE_BLOCKS
#: of them, if these are neither smaller nor larger than BLOCK allows. Each set is written once for every block of its bucket.
LIMIT, DENSE_BLOCKS, BLOCK = 1000, 50, (400, 2000)
#: A larger bucket is dense, and not split, if its mean similarity is at least this; splitting ends at this depth anyway.
DENSE, DEPTH = 0.4, 12
#: The part of 1 - recall that the filter on sketches may take.
FILTERED = 0.1
#: Ids that may be broadcast to pick out the texts of candidates.
BROADCAST_IDS = 1_000_000


# ---- what is missed --------------------------------------------------------------------------------------------------


def least_equal(threshold: float, recall: float) -> int:
    """Hashes that sketches of candidates share at least: a pair at the threshold has fewer with FILTERED * (1 - recall)."""
    below = 0.0
    for m in range(SKETCH + 1):
        below += math.comb(SKETCH, m) * threshold**m * (1 - threshold) ** (SKETCH - m)
        if below > FILTERED * (1 - recall):
            return m
    return SKETCH


def missed(threshold: float, recall: float, runs: int, splits: int) -> float:
    """Probability that a pair at the threshold is not found in `runs` runs whose buckets are split `splits` times: its sketches
    share too few hashes, or no run has both a shared root and a shared token at each split. All runs use the same sketch."""
    out, need = 0.0, least_equal(threshold, recall)
    for m in range(SKETCH + 1):
        lost = 1.0
        if m >= need:
            apart = math.comb(SKETCH - m, TOKENS) / math.comb(SKETCH, TOKENS)
            fails = 1 - (1 - apart) ** splits
            ways = [math.comb(m, r) * math.comb(SKETCH - m, runs - r) for r in range(runs + 1)]
            lost = sum(w * fails**r for r, w in enumerate(ways)) / math.comb(SKETCH, runs)
        out += math.comb(SKETCH, m) * threshold**m * (1 - threshold) ** (SKETCH - m) * lost
    return out


def runs_for(threshold: float, recall: float, splits: int) -> int:
    return next((n for n in range(1, SKETCH) if missed(threshold, recall, n, splits) <= 1 - recall), SKETCH - 1)


# ---- sets and sketches, in workers -----------------------------------------------------------------------------------


class Shingler:
    """Sets of 64-bit shingle hashes, as sorted arrays; words are taken after A-Z to a-z."""

    def __init__(self, n: int):
        self.n, self.ids = n, WordIds(lambda word: xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        words = words_of(lowered(text or ""))
        self.ids.fresh()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.ids.hashes_of(self.ids.of(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(shingles), 4096):
            part = (shingles[k : k + 4096, None] * self.factors) >> np.uint64(32)
            np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
        return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal (long) keys, from batches that are sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        cols = [t.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for a, z in zip(edges, edges[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(edges[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def pair_mask(part: np.ndarray, p: int, q: int, leaf: int, leaves: list[np.ndarray]) -> np.ndarray:
    """Pairs (i < j by row) of a group that are its own: of its two blocks, and with no earlier leaf in common."""
    n = len(part)
    own = np.triu(np.ones((n, n), bool), 1) if p == q else (part[:, None] == p) & (part[None, :] == q)
    flat, owner = np.concatenate(leaves), np.repeat(np.arange(n), [len(x) for x in leaves])
    early = flat < leaf
    if early.any():
        names, col = np.unique(flat[early], return_inverse=True)
        for k in range(0, len(names), 4096):
            inside = np.zeros((n, min(4096, len(names) - k)), np.float32)
            here = (col >= k) & (col < k + 4096)
            inside[owner[early][here], col[here] - k] = 1
            own &= (inside @ inside.T) == 0
    return own


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections in a group, by products of membership matrices a few thousand shingles at a time."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    col, owner = number[col[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    out, total = np.zeros((n, n)), int(shared.sum())
    for k in range(0, total, 2048):
        a, z = np.searchsorted(col, (k, k + 2048))
        inside = np.zeros((n, min(2048, total - k)), np.float32)
        inside[owner[a:z], col[a:z] - k] = 1
        out += inside @ inside.T
    return out


def similar(inter: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    return inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9


def components(links: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    label = np.arange(len(links))
    i, j = np.nonzero(links)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


# ---- the Spark job ---------------------------------------------------------------------------------------------------


def sketches(docs: DataFrame, n: int, with_text: bool = False) -> DataFrame:
    """id, carried, text if asked for, key (digest of the set), sketch of each row."""
    back = ["id", "carried", *(["text"] if with_text else [])]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(n)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                keys, rows = [], np.zeros((part.num_rows, SKETCH), np.uint32)
                for i, x in enumerate(part.column("text")):
                    own = s.shingles(x.as_py())
                    keys.append(digest(own))
                    rows[i] = s.sketch(own)
                sketch = pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int32).ravel()), SKETCH).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in back), pa.array(keys, pa.binary()), sketch], names=[*back, "key", "sketch"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(make, f"{', '.join(f'{c} {kinds[c]}' for c in back)}, key binary, sketch array<int>")


def leaves_of(sets: DataFrame, runs: range) -> tuple[DataFrame, int]:
    """leaf (long, the run in its highest bits), key, blocks: the buckets that are compared by brute force; and how often the
    most split bucket was split."""

    def bucket(run, *of):
        return F.shiftleft(run.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*of), 8))

    def kept(rows: DataFrame) -> DataFrame:
        """With the bucket's size; sets alone in a bucket go. Sizes are written first, so that a large bucket can be split."""
        sizes = staged(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        return rows.join(sizes, "bucket")

    blocks = F.ceil(F.col("n") / F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.ceil(F.col("n") / DENSE_BLOCKS))))
    roots = F.array(*[bucket(F.lit(r), F.lit(r), F.get("sketch", F.lit(r))) for r in runs])
    rows = staged(kept(sets.select("key", F.explode(roots).alias("bucket"))))
    found = [rows.where(F.col("n") <= LIMIT).select(F.col("bucket").alias("leaf"), "key", F.lit(1).cast("long").alias("blocks"))]
    rows, splits = rows.where(F.col("n") > LIMIT), 0
    # as SKETCH is a power of two and the step is odd, a bucket's tokens are distinct
    first, step = (F.pmod(F.xxhash64("bucket", F.lit(x)), F.lit(SKETCH)).cast("int") for x in (0, 1))
    for depth in range(DEPTH):
        if rows.isEmpty():
            break
        tokens = F.array(*[F.struct(F.lit(t).alias("t"), F.get("sketch", (first + t * step.bitwiseOR(F.lit(1))) % SKETCH).alias("v")) for t in range(TOKENS)])
        split = rows.join(sets, "key").select("key", F.col("bucket").alias("parent"), F.col("n").alias("n_parent"), F.inline(tokens))
        run = F.shiftrightunsigned("parent", 56)
        split = staged(split.select("key", "parent", "n_parent", bucket(run, F.col("parent"), F.col("t"), F.col("v")).alias("bucket")))
        child = split.groupBy("parent", "n_parent", "bucket").agg(F.count("*").alias("c"))
        mean = child.groupBy("parent", "n_parent").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s"))
        dense = F.lit(depth == DEPTH - 1) | (F.col("s") >= DENSE * TOKENS * F.col("n_parent").cast("double") * F.col("n_parent"))
        parents = staged(mean.select("parent", dense.alias("dense")))
        if parents.where("not dense").isEmpty():
            found.append(rows.select(F.col("bucket").alias("leaf"), "key", blocks.alias("blocks")))
            break
        splits = depth + 1
        whole = rows.join(parents.where("dense").withColumnRenamed("parent", "bucket"), "bucket")
        found.append(whole.select(F.col("bucket").alias("leaf"), "key", blocks.alias("blocks")))
        below = staged(kept(split.join(parents.where("not dense"), "parent").select("key", "bucket").distinct()))
        found.append(below.where(F.col("n") <= LIMIT).select(F.col("bucket").alias("leaf"), "key", F.lit(1).cast("long").alias("blocks")))
        rows = below.where(F.col("n") > LIMIT)
    return staged(reduce(DataFrame.unionByName, found)), splits


def all_leaves_of(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """The leaves of as many runs as the splits that were really made ask for."""
    found, runs, splits = [], 0, 1
    while (wanted := runs_for(threshold, recall, splits)) > runs:
        leaves, most = leaves_of(sets, range(runs, wanted))
        found.append(leaves)
        runs, splits = wanted, max(splits, most)
    return reduce(DataFrame.unionByName, found)


def blocks_of(leaves: DataFrame) -> DataFrame:
    """Each member of a leaf once for every pair of blocks that has its own: leaf, p, q, part, key, leaves (sorted)."""
    part = F.pmod(F.xxhash64("key"), F.col("blocks"))
    all_leaves = leaves.groupBy("key").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    rows = leaves.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("leaf", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "key")
    return rows.join(all_leaves, "key")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q")


def candidates(members: DataFrame, need: int) -> DataFrame:
    """The members of each group that have a candidate of their own in it: sketches that share at least `need` hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in in_groups(batches, ["leaf", "p", "q"]):
            n = g.num_rows
            if n < 2:
                continue
            sketch = g.column("sketch").combine_chunks().flatten().to_numpy().reshape(n, SKETCH)
            equal = np.zeros((n, n), np.uint8)
            for k in range(SKETCH):
                equal += sketch[:, k, None] == sketch[None, :, k]
            near = equal >= need
            if n > 2 or near[0, 1]:
                leaf, p, q = (g.column(c)[0].as_py() for c in ("leaf", "p", "q"))
                near &= pair_mask(g.column("part").to_numpy(), p, q, leaf, [np.array(x) for x in g.column("leaves").to_pylist()])
                hit = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
                if len(hit):
                    yield from g.select(["leaf", "p", "q", "part", "key", "leaves"]).take(pa.array(hit)).combine_chunks().to_batches()

    return members.mapInArrow(find, "leaf long, p long, q long, part long, key binary, leaves array<long>")


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """key, links (verified in this group), root (smallest key of the member's component in it), from members with whole sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in in_groups(batches, ["leaf", "p", "q"]):
            if g.num_rows < 2:
                continue
            g = g.take(pa.array(np.argsort(np.array(g.column("key").to_pylist(), dtype=object), kind="stable")))
            sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
            links = similar(intersections(sets), np.array([len(x) for x in sets]), threshold)
            leaf, p, q = (g.column(c)[0].as_py() for c in ("leaf", "p", "q"))
            own = pair_mask(g.column("part").to_numpy(), p, q, leaf, [np.array(x) for x in g.column("leaves").to_pylist()])
            links &= own | own.T
            np.fill_diagonal(links, False)
            degree = links.sum(axis=1)
            if degree.any():
                keys = g.column("key").to_pylist()
                roots = components(links)
                hit = np.flatnonzero(degree).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), pa.array(degree[hit], pa.int64()), pa.array([keys[roots[i]] for i in hit], pa.binary())], names=["key", "links", "root"])

    return members.mapInArrow(verify, "key binary, links long, root binary")


def connected(edges: DataFrame) -> DataFrame:
    """key, label (smallest key of its component) from edges (key, root): minimum labels pass along the edges and labels of
    labels are taken, until nothing changes. Joins are of tables that are written down, so that adaptive execution splits a
    label, or a root, with very many members."""
    both = staged(edges.where("key != root").distinct())
    both = staged(both.select(F.col("key").alias("a"), F.col("root").alias("b")).union(both.select("root", "key")).distinct())
    labels = staged(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("key"), F.least("a", "label").alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "key"), "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        new = staged(new.join(jump, "label", "left").select("key", "old", F.least("label", "far").alias("label")))
        labels = new.select("key", "label")
        if new.where("label != old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, recall: float = 0.999999, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, class_id (smallest id of its component of near duplicates), copy_id (smallest id among rows with the
    same shingle set), n_copies (other rows with that set), n_links (other sets at Jaccard similarity >= threshold), stays
    (boolean; true for one row of each class, one with the smallest id), then the columns of `carry`.

    Words are what ASCII white space separates, after A-Z to a-z; a text of fewer than `ngram` words has one shingle, all its
    words. Links are exact for the pairs found; a pair at the threshold is missed with a probability below 1 - recall, sketch
    filter and splits together.

    Rows without words (null, empty or blank text) are copies of each other and link to nothing. Repeated rows are copies;
    rows of different texts stay apart though they share an id. Null ids are never the smallest; a class without any id has
    null. An empty table gives no rows. Other columns are ignored. Copies meet as sums; a bucket is compared by groups of at
    most LIMIT sets, or two blocks, whatever it holds."""
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry if c != text_col])  # a text goes to the workers once
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))
    with scratch(docs.sparkSession):
        rows = staged(sketches(base, ngram, text_col in carry).withColumn("row", F.monotonically_increasing_id()), keep=True)
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
        copies = staged(rows.groupBy("key").agg(first, F.count("*").alias("n"), F.first("sketch").alias("sketch")))
        sets = copies.where(F.col("key") != F.lit(digest(np.zeros(0, np.uint64)))).select("key", "sketch")

        members = staged(blocks_of(all_leaves_of(sets, threshold, recall)))
        close = staged(candidates(dealt(members.join(sets, "key")), least_equal(threshold, recall)))
        wanted = staged(copies.join(close.select("key").distinct(), "key", "left_semi").select("key", F.col("first.id").alias("copy_id")))
        ids = wanted.select(F.col("copy_id").alias("wanted_id")).distinct()
        texts = base.join(broadcast_if_small(ids, wanted.count(), BROADCAST_IDS), F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Shingler(ngram)
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    sets = [x for x in map(s.shingles, b.slice(k, 256).column("text").to_pylist()) if len(x)]
                    yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "shingles"])

        full = staged(texts.select("text").mapInArrow(whole, "key binary, shingles binary").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))
        links = staged(verified(dealt(close.join(full, "key")), threshold))
        degree = links.groupBy("key").agg(F.sum("links").alias("links"))
        labels = connected(links.select("key", "root"))
        classes = copies.select("key", "first", "n").join(degree, "key", "left").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        classes = staged(classes)
        least = classes.where("label != key or links is not null").groupBy("label").agg(F.min("first").alias("class_first"))
        classes = staged(classes.join(least, "label", "left").withColumn("class_first", F.coalesce("class_first", "first")).drop("label"), keep=True)
    out = rows.drop("sketch").join(classes, "key")
    return out.select(
        F.col("id").alias(id_col), F.col("class_first.id").alias("class_id"), F.col("first.id").alias("copy_id"), (F.col("n") - 1).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"),
        (F.col("row") == F.col("class_first.row")).alias("stays"), *[(F.col("text") if c == text_col else F.col("carried")[c]).alias(c) for c in carry])
