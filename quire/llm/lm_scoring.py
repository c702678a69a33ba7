"""Language-model scores: word unigrams with add-half smoothing, and prediction by partial matching (PPM-C) over bytes.

The PPM model is pretrained: a trie of contexts with their followers' counts, from all training texts, whose last symbol is an
end. The escape estimate of a context is (distinct followers) / (count + distinct followers). Short contexts, of up to three
bytes, are followed by bytes; followers that a longer context already ruled out are excluded from shorter ones. As counts of
all contexts are full sums, the followers of a context are among those of its suffix, so each context's whole distribution
over the 256 bytes can be worked out once. The frequent contexts' distributions go to every worker; a byte after any other
context gets its probability by a join with the counts of all contexts.

Long contexts are held path-compressed: an edge of the trie is a few words, cut where a hash of the last two words says so,
and an edge's context are the two edges before it. A text goes along an edge that followed its context in training, or escapes
and spells the edge's bytes from the short contexts. There are as many long contexts as the corpus has places, so none goes
to a worker: the workers score blocks of texts, deal their distinct edges by context, and get back what is known of them."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import scratch, staged
from quire.llm.words import WORDS

#: Contexts of each order (0 to 3 bytes) whose rows every worker holds, the most frequent first; of orders 0 and 1 that is
#: all there are. Bounds what reaches the driver (256 followers a context) and what workers hold. Bytes after all other
#: contexts are scored by a join, so that no context is dropped.
NODES = (1, 256, 8_192, 16_384)
ORDER = len(NODES) - 1
#: Words that training holds most often, at most so many: their counts (8 bytes and a word each) go to every worker; all
#: rarer words get their counts by a join.
POPULAR = 200_000
#: Word counts that a worker gathers before it hands them on.
GATHERED = 300_000
START = b"\n" * ORDER
#: Stands for the end of a text; no byte of UTF-8 is 255.
END = b"\xff"
#: One in so many words ends an edge, and the first one does (the first edge has no context, and is spelt); so many bytes of a text are hashed at a time.
EDGE, STRETCH = 3, 1 << 18
#: Bytes of text whose edges are dealt together, and bytes of text in all for which edges meet in one group.
BLOCK, SHARD = 1 << 22, 1 << 23
#: Contexts with so many distinct edges in a block of texts, and so many in all such blocks together, have their edges dealt to all
#: groups; at most so many contexts, the most frequent ones.
HOT_BLOCK, HOT, MOST_HOT = 32, 50_000, 100_000
#: Bytes of a hash that tell contexts apart, and edges of a context.
KEPT = 6
_DOWN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_DOWN)


def words_of(data: bytes) -> list[str]:
    return WORDS(data.decode("utf-8", "surrogatepass"))


# ---- PPM -----------------------------------------------------------------------------------------------------------------


def grams(data: bytes) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one 32-bit number; START stands before the text."""
    return _grams(np.frombuffer(START + data, np.uint8))


def _grams(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.uint32)
    out = b[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= b[ORDER - k : len(b) - k] << np.uint32(8 * k)
    return out


class GramCounts:
    """Sums of grams (as numbers) that a worker has met."""

    def __init__(self):
        self.keys, self.sums, self.waiting, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

    def add(self, data: bytes) -> None:
        self.waiting.append(grams(data))
        self.size += len(self.waiting[-1])
        if self.size > 1 << 22:
            self.fold()

    def fold(self) -> None:
        new, n = np.unique(np.concatenate([self.keys[:0], *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        self.keys, inverse = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.sums = np.bincount(inverse, np.concatenate([self.sums, n]), len(self.keys)).astype(np.int64)


def busy_contexts(context: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with HOT_BLOCK distinct edges or more among these, and how many."""
    inside = context != 0
    c, e = context[inside] & LOW, own[inside] & LOW
    order = np.lexsort((e, c))
    c, e = c[order], e[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (e[1:] != e[:-1])])[: len(c)]
    found, n = np.unique(c[new], return_counts=True)
    return found[n >= HOT_BLOCK], n[n >= HOT_BLOCK]


def count_all(texts: DataFrame) -> DataFrame:
    """kind, word, number, n over texts(text), in one pass. Kind 0: word, without ends, after A-Z to a-z; 1: how often each byte follows each ORDER bytes (number: the gram);
    2: busy_contexts() of each BLOCK of bytes. Summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams, cutter, edges, size = GramCounts(), Edges(), [], 0

        def out(kind: int, word: list | None, number: np.ndarray | None, n: list | np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(n), 50_000):
                m = len(n[k : k + 50_000])
                columns = [pa.array([kind] * m, pa.int32()), pa.nulls(m, pa.string()) if word is None else pa.array(word[k : k + m], pa.binary()).cast(pa.string()), pa.nulls(m, pa.int64()) if number is None else pa.array(number[k : k + m].astype(np.int64)), pa.array(n[k : k + m], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "word", "number", "n"])

        def words_out() -> Iterator[pa.RecordBatch]:
            yield from out(0, list(words.keys()), None, list(words.values()))
            words.clear()

        def edges_out() -> Iterator[pa.RecordBatch]:
            if edges:
                yield from out(2, None, *busy_contexts(*map(np.concatenate, zip(*edges, strict=True))))
            edges.clear()

        for b in batches:
            for x in b.column("text"):
                data = lowered(x.as_py())
                words.update(data.split())  # ASCII white space parts bytes as it parts words
                grams.add(data + END)
                _, own, context = cutter.of(data + END)
                edges.append((context, own))
                size += len(data)
                if len(words) > GATHERED:
                    yield from words_out()
                if size > BLOCK:
                    yield from edges_out()
                    size = 0
        grams.fold()
        yield from words_out()
        yield from edges_out()
        yield from out(1, None, grams.keys, grams.sums)

    return texts.mapInArrow(count, "kind int, word string, number long, n long").groupBy("kind", "word", "number").agg(F.sum("n").alias("n"))


class Ppm:
    """The trie's contexts as rows of a table: log10 P(byte | context) with escapes and exclusions worked out.

    keys[k], first[k]: sorted contexts of k bytes (as numbers) and the first one's row. Order 0 is always there. low[k]: for
    k < 2, each context's counts and the distribution over the bytes that do not follow it. cut: whether training saw
    contexts that have no row."""

    def __init__(self, levels: list[dict[int, np.ndarray]], cut: bool = False):
        """levels[k]: context of k bytes -> 256 counts of followers. above: for each context one byte shorter, its counts
        and the distribution over the bytes that do not follow it, from the contexts below."""
        self.cut, self.low = cut, []
        uniform = np.full(256, 1 / 256)
        rows, self.keys, self.first = [], [], []
        above: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, level in enumerate(levels):
            keys = np.array(sorted(level), np.int64)
            self.keys.append(keys)
            self.first.append(len(rows))
            here: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for key in keys.tolist():
                c = level[key].astype(np.float64)
                seen = c > 0
                below = self._excluding(above.get(key & ((1 << 8 * (k - 1)) - 1)) if k else None, seen, uniform)
                rows.append(self._row(c, below))
                here[key] = (c, below)
            above = here
            if k < 2:
                self.low.append(here)
        self.table = np.log10(np.maximum(np.array(rows), 1e-300)).astype(np.float32)

    def data(self) -> dict:
        """Plain arrays: broadcasts, unlike functions, are not pickled by value."""
        return dict(vars(self))

    @classmethod
    def of(cls, data: dict) -> "Ppm":
        ppm = cls.__new__(cls)
        vars(ppm).update(data)
        return ppm

    @staticmethod
    def _row(c: np.ndarray, below: np.ndarray) -> np.ndarray:
        """A context's distribution from its counts and the one over the bytes that do not follow it."""
        seen = c > 0
        total = c.sum() + seen.sum()
        return c / total + np.where(seen, 0, seen.sum() / total * below) if total else below

    def rare(self, suffix: int, counted: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """log10 P of each asked gram. All grams end in the two bytes `suffix` and a byte; counted, n: all of training's."""
        uniform = np.full(256, 1 / 256)
        short = self.low[1].get(suffix & 255)
        if not len(counted):
            row = self._row(*(short or self.low[0][0]))
            return np.log10(np.maximum(row[asked & 255], 1e-300))
        c2 = np.bincount(counted & 255, n, 256)
        below = self._excluding(short, c2 > 0, uniform)
        out, context = np.tile(self._row(c2, below), (len(asked), 1)), asked >> 8
        for key in np.intersect1d(context, counted >> 8):
            here = counted >> 8 == key
            c = np.bincount(counted[here] & 255, n[here], 256)
            out[context == key] = self._row(c, self._excluding((c2, below), c > 0, uniform))
        return np.log10(np.maximum(out[np.arange(len(asked)), asked & 255], 1e-300))

    @staticmethod
    def _excluding(parent: tuple[np.ndarray, np.ndarray] | None, seen: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """Distribution over the bytes that `seen` does not rule out, by the parent context and those below it."""
        if parent is None:
            left = np.where(seen, 0, uniform)
            return left / left.sum() if left.sum() else left
        counts, below = parent
        left = np.where(seen, 0, counts)
        d = (left > 0).sum()
        if not d:
            return below
        p = left / (left.sum() + d)
        return p + np.where(counts > 0, 0, d / (left.sum() + d) * below)

    def rows_of(self, contexts: np.ndarray) -> np.ndarray:
        """For each number of ORDER bytes, the row of its longest suffix in the trie."""
        out = np.zeros(len(contexts), np.int32)
        for k in range(1, ORDER + 1):
            keys = self.keys[k]
            if len(keys):
                part = contexts & ((1 << 8 * k) - 1)
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                out = np.where(keys[at] == part, self.first[k] + at, out).astype(np.int32)
        return out


def most_frequent(rows: DataFrame, n: str, most: int) -> int:
    """The least count such that at most `most` rows (unless many are tied) have it or more, to an eighth of a power of two: from
    sums by size, so that no task meets more than some hundred rows."""
    size = F.floor(8 * F.log2(n)).alias("size")
    left, least = most, None
    for r in sorted(rows.groupBy(size).agg(F.count("*").alias("k"), F.min(n).alias("least")).collect(), key=lambda r: -r["size"]):
        left -= r["k"]
        if left < 0:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def ppm_of(counts: DataFrame) -> Ppm:
    """The rows of each order's NODES most frequent contexts, from gram counts; their followers' sums come to the driver."""
    levels: list[dict[int, np.ndarray]] = []
    for k, most in enumerate(NODES):
        context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)) if k else F.lit(0).cast("long")
        sums = counts.groupBy(context.alias("context"), F.col("gram").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("n").alias("n"))
        if k > 1:
            totals = staged(sums.groupBy("context").agg(F.sum("n").alias("total")))
            top = totals.where(F.col("total") >= most_frequent(totals, "total", most)).select("context")
            sums = sums.join(F.broadcast(top), "context")  # at most NODES rows
        got = sums.toPandas()
        level: dict[int, np.ndarray] = {} if k else {0: np.zeros(256)}
        order = np.argsort(got["context"].to_numpy(), kind="stable")
        keys, byte, n = (got[c].to_numpy()[order] for c in ("context", "byte", "n"))
        for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []:
            level[int(keys[at[0]])] = np.bincount(byte[at], n[at], 256)
        levels.append(level)
    for k in range(1, ORDER + 1):  # a context stays only if its suffix does
        levels[k] = {c: v for c, v in levels[k].items() if c & ((1 << 8 * (k - 1)) - 1) in levels[k - 1]}
    contexts = counts.select(F.shiftright("gram", 8)).distinct().count()
    return Ppm(levels, len(levels[ORDER]) < contexts)


def rare_logs(counts: DataFrame, asked: DataFrame, shared: Broadcast) -> DataFrame:
    """gram, log: log10 P of the last byte of each of asked (gram, distinct), from the counts of all contexts. Grams that share
    their contexts' last two bytes, 2**16 at most on either side, meet in one group: it holds all that their trie nodes need.
    shared.value[1] has the Ppm."""
    suffix = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("suffix")
    asked = asked.select("gram", suffix)
    counts = counts.select("gram", "n", suffix).join(asked.select("suffix").distinct(), "suffix", "left_semi").select("gram", "n", "suffix")

    def logs(key: tuple, counted: pa.Table, asked: pa.Table) -> pa.Table:
        gram = asked.column("gram").to_numpy()
        log = Ppm.of(shared.value[1]).rare(key[0].as_py(), counted.column("gram").to_numpy(), counted.column("n").to_numpy(), gram)
        return pa.table({"gram": gram, "log": log})

    return counts.groupBy("suffix").cogroup(asked.groupBy("suffix")).applyInArrow(logs, "gram long, log double")


class PpmScorer:
    """Scores texts by a Ppm, in a worker. Contexts over the bytes that occur in the trie are numbered, so that a row is one
    look-up; if they are too many for such a list, rows are searched."""

    MOST = 1 << 21

    def __init__(self, ppm: Ppm):
        self.ppm, self.table = ppm, ppm.table.ravel()
        used = np.unique(np.concatenate([k >> (8 * i) & 255 for n, k in enumerate(ppm.keys) for i in range(n)] or [np.zeros(0, np.int64)])).astype(np.int64)
        self.a = len(used) + 1  # the last rank: any other byte
        self.rows = None
        if self.a**ORDER > self.MOST:
            return
        self.rank = np.full(256, len(used), np.int64)
        self.rank[used] = np.arange(len(used))
        other = next((x for x in range(256) if x not in used), 0)
        values, grid = np.append(used, other), np.arange(self.a**ORDER)
        contexts = sum(values[grid // self.a**k % self.a] << (8 * k) for k in range(ORDER))
        self.rows = ppm.rows_of(contexts)

    def score(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of each byte's probability, 0 for bytes whose context may be one without a row; these bytes' places and grams."""
        logs, places, grams = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k in range(0, len(data), 1 << 20):
            b = np.frombuffer((data[k - ORDER : k] if k else START) + data[k : k + (1 << 20)], np.uint8)
            r = self.rank.take(b) if self.rows is not None else b.astype(np.int64)
            base = self.a if self.rows is not None else 256
            at = r[:-ORDER].copy()
            for j in range(1, ORDER):
                at *= base
                at += r[j : j - ORDER]
            row = self.rows.take(at) if self.rows is not None else self.ppm.rows_of(at)
            log = self.table.take(row.astype(np.int64) * 256 + b[ORDER:])
            if self.ppm.cut:
                rare = np.flatnonzero(row < self.ppm.first[ORDER])
                log[rare] = 0
                places.append(rare + k)
                grams.append(_grams(b)[rare])
            logs.append(log)
        return np.concatenate(logs), np.concatenate(places), np.concatenate(grams)


# ---- edges: long contexts ------------------------------------------------------------------------------------------------


#: Added to an answer's log if the edge is not among its context's followers.
ESCAPED = 100


class Edges:
    """Cuts texts into edges and hashes them and their contexts, by prefix sums over the bytes."""

    def __init__(self):
        rng = np.random.default_rng(11)
        self.signs = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        odd = 0x9E3779B97F4A7C15
        self.up, self.down = (np.cumprod(np.full(STRETCH + 1, x, np.uint64)) for x in (odd, pow(odd, -1, 1 << 64)))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32, END[0]]] = True

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the edges of a text (with END) begin, their hashes, and their contexts' (0: the first one, which has none).

        A range's hash comes from the sums before its begin and its end and a power for its begin; so only these numbers are kept
        of a stretch, for each of its words, and ranges may lie across stretches."""
        words, total, scale, unscale, apart = [], 0, 1, 1, True
        for base in range(0, len(data), STRETCH):
            b = np.frombuffer(data, np.uint8, min(STRETCH, len(data) - base), base)
            local = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.signs[b] * self.up[: len(b)])])
            space = self.space[b]
            before = np.concatenate([[apart], space[:-1]])
            first, past = np.flatnonzero(~space & before), np.flatnonzero(space & ~before) + 1  # past the sign that ends a word
            part = [local[first], self.down[first], past + base, local[past], self.down[past]]
            upto = int(local[-1])
            if base:  # sums and powers go on from the stretches before
                for k, factor, add in ((0, scale, total), (1, unscale, 0), (3, scale, total), (4, unscale, 0)):
                    part[k] = part[k] * np.uint64(factor) + np.uint64(add)
                upto = (upto * scale + total) % (1 << 64)
            words.append(part)
            total, apart = upto, bool(space[-1])
            scale, unscale = scale * int(self.up[len(b) - 1]) % (1 << 64), unscale * int(self.down[len(b) - 1]) % (1 << 64)
        sum_b, down_b, end, sum_e, down_e = words[0] if len(words) == 1 else (np.concatenate(x) for x in zip(*words, strict=True))
        back = lambda x, n: np.concatenate([np.repeat(x[:1], n), x])[: len(x)]
        pair = self._mixed((sum_e - back(sum_b, 1)) * back(down_b, 1))
        cut = np.flatnonzero(((pair % np.uint64(EDGE) == 0) | (np.arange(len(end)) == 0)) & (end < len(data)))
        begin = np.concatenate([[0], end[cut]])
        sums, down = np.concatenate([np.zeros(1, np.uint64), sum_e[cut]]), np.concatenate([self.down[:1], down_e[cut]])
        own = self._mixed((np.append(sums[1:], np.uint64(total)) - sums) * down)
        context = self._mixed((sums - back(sums, 2)) * back(down, 2))
        context[1:2] ^= np.uint64(0x5851F42D4C957F2D)  # an edge alone is not two edges
        context |= np.uint64(1)
        context[0] = 0
        return begin, own, context


#: Mask of the bytes that are kept of a hash.
LOW = np.uint64((1 << 8 * KEPT) - 1)


def _bytes_of(x: np.ndarray, n: int) -> bytes:
    """The lowest n bytes of each 64-bit number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _numbers_of(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def pair_blob(first: int, context: np.ndarray, edge: np.ndarray, seen: np.ndarray) -> bytes:
    """Pairs of context (ascending) and edge, numbered from `first`, and how often training has each: contexts as steps of as many bytes
    as the longest needs, edges by KEPT bytes, counts as a bit and the exceptions."""
    step = np.diff(context, prepend=context[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    many = np.flatnonzero(seen > 1).astype(np.int32)
    head = np.array([first, len(context), width, len(many)], np.int32).tobytes() + context[:1].tobytes()
    return head + _bytes_of(step, width) + _bytes_of(edge, KEPT) + np.packbits(seen > 0).tobytes() + many.tobytes() + seen[many].astype(np.int64).tobytes()


def pairs_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, contexts, edges and counts of a pair_blob()."""
    first, n, width, n_many = np.frombuffer(blob, np.int32, 4).tolist()
    at = 24
    parts = []
    for size in (n * width, n * KEPT, -(-n // 8), 4 * n_many, 8 * n_many):
        parts.append(blob[at : at + size])
        at += size
    context = np.cumsum(_numbers_of(parts[0], width)) + np.frombuffer(blob, np.uint64, 1, 16)
    seen = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=n).astype(np.int64)
    seen[np.frombuffer(parts[3], np.int32)] = np.frombuffer(parts[4], np.int64)
    return np.arange(first, first + n), context, _numbers_of(parts[1], KEPT), seen


class Block:
    """Edges of the texts that one worker scores in turn: what the shards need of them, and what the block keeps."""

    def __init__(self):
        self.size, self.texts, self.n = 0, [], 0

    def add(self, edges: tuple[np.ndarray, np.ndarray, np.ndarray], scored: tuple[np.ndarray, np.ndarray, np.ndarray], train: bool) -> tuple[int, int]:
        begin, own, context = edges
        logs, places, grams = scored
        spelt = np.add.reduceat(logs, begin, dtype=np.float64).astype(np.float32)
        self.texts.append((own, context, spelt, np.searchsorted(begin, places, side="right") - 1 + self.n, grams, np.full(len(own), train)))
        self.size += len(logs)
        self.n += len(own)
        return self.n - len(own), len(own)

    def close(self, shards: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, contents). The block's distinct pairs of context and edge are numbered by shard, context and edge, and go to
        their shards as pair_blob()s: to that of the context, or for a hot context (`hot`, ascending) to that of the pair,
        which are numbered from `shards`. The block keeps, as shard -1, the number of each of its edges (-1 without
        context), which numbers are from training, and of edges that aren't so the log when spelt and the rare bytes in them."""
        own, context, spelt, at, grams, train = map(np.concatenate, zip(*self.texts, strict=True))
        inside = np.flatnonzero(context)
        c, e = context[inside] & LOW, own[inside] & LOW
        mix = c ^ (c >> np.uint64(23))
        shard = (mix % np.uint64(shards)).astype(np.int32)
        if len(hot):
            pair = Edges._mixed(c + e * np.uint64(0x9E3779B97F4A7C15))
            shard = np.where(hot[np.minimum(np.searchsorted(hot, c), len(hot) - 1)] == c, (shards + (pair % np.uint64(shards))).astype(np.int32), shard)
        order = np.lexsort((e, c, shard))
        c, e, shard = c[order], e[order], shard[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (e[1:] != e[:-1])])[: len(order)]
        number = np.full(len(own), -1, np.int32)
        number[inside[order]] = np.cumsum(new) - 1
        c, e, shard = c[new], e[new], shard[new]
        seen = np.bincount(number[inside], train[inside], len(c)).astype(np.int64)
        unsure = np.full(len(own), True)
        unsure[inside] = seen[number[inside]] == 0
        yield -1, pickle.dumps((number, np.packbits(seen > 0), np.where(unsure, spelt, np.float32(0)), at[unsure[at]].astype(np.int32), grams[unsure[at]]))
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield int(shard[a]), pair_blob(a, c[a:z], e[a:z], seen[a:z])


def merged_pairs(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the pairs of several blobs, by context and edge: blob, number, context, edge's count, whether the blob's own training has it, and
    for each pair which distinct pair and which context it is."""
    parts = [pairs_of(x) for x in blobs]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    number, context, edge, seen = map(np.concatenate, zip(*parts, strict=True))
    del parts
    order = np.lexsort((edge, context))
    context, edge = context[order], edge[order]
    new_context = np.concatenate([[True], context[1:] != context[:-1]])
    new = new_context | np.concatenate([[True], edge[1:] != edge[:-1]])
    pair = np.cumsum(new) - 1
    return owner[order], number[order], context, np.bincount(pair, seen[order]), seen[order] > 0, pair, new, np.cumsum(new_context) - 1


def hot_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hot contexts (ascending), how many edges training has after each, and how many distinct ones; from (shard, blob) of their
    pairs. A row for each, MOST_HOT at most, comes to the driver."""

    def sums(key: tuple, t: pa.Table) -> pa.Table:
        _, _, context, c, _, _, new, group = merged_pairs(t.column("blob").to_pylist())
        first = np.concatenate([[True], group[1:] != group[:-1]])
        return pa.table({"context": context[first].astype(np.int64), "n": np.bincount(group[new], c).astype(np.int64), "d": np.bincount(group[new], c > 0).astype(np.int64)})

    found = rows.groupBy("shard").applyInArrow(sums, "context long, n long, d long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).toPandas().sort_values("context")
    return found["context"].to_numpy(np.uint64), found["n"].to_numpy(), found["d"].to_numpy()


def known_edges(rows: DataFrame, hot: Broadcast | None = None) -> DataFrame:
    """block, answers: what training says of the blocks' edges, from (shard, block, blob). Each shard has all edges of its contexts,
    each of them at most once a block; or with `hot`, which has the hot_sums(), all of an edge of a hot context. An answer is (edge's number, log10, whether it escapes); left out are edges for which
    what the block assumes holds: in a context seen once, by the block's own training text, or in one never seen."""

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        owner, number, context, c, own, pair, new, group = merged_pairs(t.column("blob").to_pylist())
        if hot is None:
            n = np.bincount(group[new], c)[group]
            d = np.bincount(group[new], c > 0)[group]
        else:
            keys, n, d = hot.value
            at = np.searchsorted(keys, context)
            n, d = n[at], d[at]
        c = c[pair]
        told = np.where(own, n + d > 2, n > 0)
        escapes = c == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.log10(np.where(escapes, d, c) / (n + d)).astype(np.float32)
        keep = np.flatnonzero(told)
        by = keep[np.argsort(owner[keep], kind="stable")]
        blocks, blobs = [], []
        for part in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(by) else []:
            blocks.append(t.column("block")[int(owner[part[0]])].as_py())
            blobs.append(pickle.dumps((number[part].astype(np.int32), np.where(escapes[part], log[part] + np.float32(ESCAPED), log[part]))))
        return pa.table({"block": pa.array(blocks, pa.int64()), "answers": pa.array(blobs, pa.binary())})

    return rows.groupBy("shard").applyInArrow(answer, "block long, answers binary")


def along_edges(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """row, log10 of a text along its edges, and the rare bytes (gram, times) in edges that it spells; from the block's rows (row,
    first, n_edges, or the block's own blob) and the answers to it."""

    def walk(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        own = np.array([x is not None for x in t.column("blob").to_pylist()])
        number, trained, spelt, at, grams = pickle.loads(t.column("blob")[int(own.argmax())].as_py())
        trained = np.unpackbits(trained, count=int(number.max(initial=-1)) + 1).astype(bool)
        log, escapes = np.where(trained, np.float32(-math.log10(2)), np.float32(0)), ~trained
        for blob in told.column("answers").to_pylist():
            k, new = pickle.loads(blob)
            escapes[k] = new > 1
            log[k] = np.where(escapes[k], new - np.float32(ESCAPED), new)
        spells = np.full(len(number), True)
        value = np.zeros(len(number))
        inside = number >= 0
        value[inside], spells[inside] = log[number[inside]], escapes[number[inside]]
        value += np.where(spells, spelt, 0)
        docs = t.select(["row", "first", "n_edges"]).filter(pa.array(~own)).sort_by("first")
        first, n = docs.column("first").to_numpy(), docs.column("n_edges").to_numpy()
        at, grams = at[spells[at]], grams[spells[at]]
        lists = []
        for a, z in zip(np.searchsorted(at, first).tolist(), np.searchsorted(at, first + n).tolist(), strict=True):
            gram, times = np.unique(grams[a:z], return_counts=True)
            lists.append([{"gram": g, "times": k} for g, k in zip(gram.tolist(), times.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))
        return pa.table({"row": docs.column("row"), "score": pa.array(np.add.reduceat(value, first)), "rare": pa.array(lists, kind)})

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, "row long, score double, rare array<struct<gram:long,times:long>>")


def word_lists(rests: list[dict[bytes, int]]) -> pa.Array:
    """Each row's words and how often it has them, as lists of (word, tf)."""
    ends = np.cumsum([0, *map(len, rests)]).astype(np.int32)
    words = pa.array(chain.from_iterable(rests), pa.binary()).cast(pa.string())
    tf = pa.array(chain.from_iterable(r.values() for r in rests), pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, tf], names=["word", "tf"]))


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row; learn from the rows where held_out (an expression over the columns of docs) is not true.

    Returns id_col, held_out, n_tokens, n_known, train_tokens (long), base_score, score, ppm_bits (double: code length of the
    text in bits). Tokens: words after A-Z to a-z, then one end. base_score: sum of log10((c+0.5)/(N+0.5*(V+1))). score:
    log10 of the PPM model's probability of the text, its end included.

    Each word is counted over all training rows. Counts of at most POPULAR frequent words go to the workers; every other
    word of a row joins with its count; such words are rare, so no key is hot. The same holds for the PPM model's short contexts
    beyond NODES: bytes after them join with their probability. Edges are dealt by their context, a distinct one once a block;
    those of a hot context by themselves, and what training has of it in all is summed first, so that no task holds it whole.

    Null or empty text: one token (the end). Repeated rows are learnt from and scored each; a null id is scored like any
    other. An empty table gives no rows. Other columns are ignored."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train, spark = base.where("not held_out"), docs.sparkSession
    found = staged(count_all(train.select("text")))
    counts, gram_counts = found.where("kind = 0").select("word", "n"), found.where("kind = 1").select(F.col("number").alias("gram"), "n")
    busy = found.where("kind = 2").where(F.col("n") >= HOT).orderBy(F.desc("n"), "number").limit(MOST_HOT).toArrow()
    hot = np.sort(busy.column("number").to_numpy().astype(np.uint64))
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends, size = base.agg(F.count_if(~F.col("held_out")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_all, n_types = words + ends, types + (ends > 0)
    below = math.log10(n_all + 0.5 * (n_types + 1))
    top = counts.where(F.col("n") >= most_frequent(counts, "n", POPULAR)).toArrow()
    known = dict(zip(map(str.encode, top.column("word").to_pylist()), [math.log10(n + 0.5) for n in top.column("n").to_pylist()], strict=True))
    with scratch(spark):
        ppm = ppm_of(gram_counts)
    shared = spark.sparkContext.broadcast((known, ppm.data(), hot))
    shards = max(8, size // SHARD)
    kind = dict(base.dtypes)["id"]
    names = ["id", "held_out", "row", "n_tokens", "n_frequent", "frequent", "rest", "block", "first", "n_edges", "shard", "blob"]
    kinds = [None, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())])), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, data, hot = shared.value
        scorer, cutter, block, n = PpmScorer(Ppm.of(data)), Edges(), Block(), TaskContext.get().partitionId() << 33
        name, id_kind = n, pa.null()

        def close() -> Iterator[pa.RecordBatch]:
            for shard, blob in block.close(shards, hot):
                row = {"block": name, "shard": shard, "blob": blob}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], t or id_kind) for c, t in zip(names, kinds, strict=True)], names=names)

        for b in batches:
            id_kind = b.column("id").type
            for k in range(0, b.num_rows, 512):
                part, rows = b.slice(k, 512), []
                for x, held in zip(part.column("text"), part.column("held_out").to_pylist(), strict=True):
                    data = lowered(x.as_py())
                    words = data.split()
                    logs, rest = list(map(known.get, words)), {}
                    if None in logs:
                        rest = Counter(w for w, log in zip(words, logs, strict=True) if log is None)
                        logs = [log for log in logs if log is not None]
                    data += END
                    first, size = block.add(cutter.of(data), scorer.score(data), not held)
                    rows.append((n, len(words) + 1, len(logs), math.fsum(logs), rest, name, first, size, None, None))
                    n += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *(word_lists(c) if pa.types.is_list(t or id_kind) else pa.array(c, t) for c, t in zip(cols, kinds[2:], strict=True))], names=names)
                if block.size > BLOCK:
                    yield from close()
                    block, name = Block(), n
        if block.n:
            yield from close()

    rows = staged(base.mapInArrow(score, f"id {kind}, held_out boolean, row long, n_tokens long, n_frequent long, frequent double, rest array<struct<word:string,tf:long>>, block long, first long, n_edges long, shard int, blob binary"))
    scored = rows.where("shard is null")
    answers = known_edges(rows.where((F.col("shard") >= 0) & (F.col("shard") < shards)).select("shard", "block", "blob"))
    if len(hot):
        of_hot = rows.where(F.col("shard") >= shards).select("shard", "block", "blob")
        answers = answers.unionByName(known_edges(of_hot, spark.sparkContext.broadcast(hot_sums(of_hot))))
    walked = staged(along_edges(rows.where("shard is null or shard < 0").select("block", "row", "first", "n_edges", "blob"), answers))
    rest = scored.select("row", F.inline("rest")).join(counts, "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5) * F.col("tf")
    rest = rest.groupBy("row").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("n_rest"))
    out = scored.select("id", "held_out", "row", "n_tokens", "n_frequent", "frequent").join(walked.select("row", "score"), "row").join(rest, "row", "left")
    if ppm.cut:
        rare = walked.select("row", F.inline("rare"))
        rare = rare.join(staged(rare_logs(gram_counts, rare.select("gram").distinct(), shared)), "gram").groupBy("row").agg(F.sum(F.col("log") * F.col("times")).alias("rare_log"))
        out = out.join(rare, "row", "left").withColumn("score", F.col("score") + F.coalesce("rare_log", F.lit(0.0)))
    base_score = F.col("frequent") + F.coalesce("log", F.lit(0.0)) + F.lit(math.log10(ends + 0.5)) - F.col("n_tokens") * F.lit(below)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rest", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), "score", (F.col("score") * F.lit(-math.log2(10))).alias("ppm_bits"),
    )
