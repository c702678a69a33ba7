"""Best-fit packing of token sequences by a linear grouping scheme.

Only the histogram of piece lengths (at most `capacity` rows) reaches the driver. The plan made from it is a list of runs
"the pieces of length L with ranks a to b go to sequences s, s+1, ..., q in each"; its size depends on the capacity and not
on the number of documents. Pieces then find their place by their length and their rank among pieces of that length."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import staged
from quire.llm.words import NUMBERED

#: Lengths above capacity / LARGE count as large; they are rounded up within so many groups of equal cardinality. More groups
#: are tried until the number of sequences meets its lower bound; the plan with the fewest sequences stands.
LARGE, GROUPS = 16, (32, 64, 128)
#: Pieces of one length are ranked in so many parts at least, and in more if a part would pass RANKED rows.
PARTS, RANKED = 64, 200_000
SHIFT = 40


# ---- the plan, from a histogram -----------------------------------------------------------------------------------------


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the sum of worths is largest and the sum of sizes at most the capacity."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if w > 0:
            for at in range(s, capacity + 1, s):  # a block rests on the block before it, so a size can be taken again
                to = min(at + s, capacity + 1)
                new = value[at - s : to - s] + w
                better = new > value[at:to] + 1e-12
                value[at:to][better] = new[better]
                choice[at:to][better] = i
    taken, left = np.zeros(len(sizes)), capacity
    while choice[left] >= 0:
        taken[choice[left]] += 1
        left -= int(sizes[choice[left]])
    return taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes and how often to use each: the linear programme of least bins by column generation,
    rounded down."""
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(sizes, worth, capacity)
        if worth @ column <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used = used - ratio[out] * step
        used[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].astype(int), n) for j, n in enumerate(np.floor(used + 1e-9).astype(int)) if n > 0]


class Plan:
    """Runs of pieces with their sequences. `free`: room -> stretches (first sequence, how many) of sequences with that room."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.placed: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset

    def place(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.placed[length], sequence, each, offset))
        self.placed[length] += n

    def fill(self, parts: list[list[tuple[int, int]]], m: int) -> None:
        """m new sequences, each with one piece of every part; a part is a list of (length, n), last first, in which lengths
        may change from one sequence to the next. The stretch is cut where they do."""
        first, self.n = self.n, self.n + m
        at, left = 0, [list(p) for p in parts]
        while at < m:
            step = min(p[-1][1] for p in left)
            offset = 0
            for p in left:
                length, n = p.pop()
                self.place(length, step, first + at, 1, offset)
                offset += length
                if n > step:
                    p.append((length, n - step))
            self.free[self.capacity - offset].append((first + at, step))
            at += step

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of one length, each into the fullest sequence that has room; new sequences when none has."""
        rooms = sorted(r for r, s in self.free.items() if r >= length and s)
        for room in [*rooms, None]:
            while n:
                if room is None:
                    room = self.capacity
                    self.free[room].append((self.n, -(-n // (room // length))))
                    self.n += -(-n // (room // length))
                if not self.free[room]:
                    break
                first, m = self.free[room].pop()
                each = room // length
                whole = min(n // each, m)
                if whole:
                    self.place(length, whole * each, first, each, self.capacity - room)
                    self.free[room - each * length].append((first, whole))
                    first, m, n = first + whole, m - whole, n - whole * each
                if m and n:  # fewer than `each` are left: they share one sequence
                    self.place(length, n, first, n, self.capacity - room)
                    self.free[room - n * length].append((first, 1))
                    first, m, n = first + 1, m - 1, 0
                if m:
                    self.free[room].append((first, m))
            if not n:
                return


def grouped(large: list[tuple[int, int]], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Rounded size -> its (length, n), longest first: groups of equal cardinality, each rounded up to its longest. If there
    are no more lengths than groups, every length is its own."""
    if len(large) <= groups:
        return {length: [(length, n)] for length, n in large}
    share = -(-sum(n for _, n in large) // groups)
    out: dict[int, list[tuple[int, int]]] = {}
    top, filled = 0, share
    for length, n in large:
        while n:
            if filled == share:
                top, filled = length, 0
            take = min(n, share - filled)
            out.setdefault(top, []).append((length, take))
            filled, n = filled + take, n - take
    return out


def plan_with(counts: dict[int, int], capacity: int, groups: int) -> Plan:
    """Configurations of the rounded large sizes are optimised, actual pieces take the rounded ones' places, and all that is
    left is best-fitted, longest first."""
    plan = Plan(capacity)
    merged = grouped([(k, counts[k]) for k in sorted(counts, reverse=True) if k > capacity // LARGE], groups)
    if merged:
        queues = [g[::-1] for g in merged.values()]  # the longest at the end
        left = [sum(n for _, n in g) for g in merged.values()]
        for taken, times in configurations(np.array(list(merged)), np.array(left, float), capacity):
            inside = np.flatnonzero(taken).tolist()
            times = min([int(times), *(left[i] // int(taken[i]) for i in inside)])
            parts = []
            for i in [i for i in inside for _ in range(taken[i])] if times else []:
                want, part = times, []
                while want:
                    length, n = queues[i].pop()
                    step = min(n, want)
                    part.append((length, step))
                    want -= step
                    if n > step:
                        queues[i].append((length, n - step))
                parts.append(part[::-1])
                left[i] -= times
            if times:
                plan.fill(parts, times)
    for length in sorted(counts, reverse=True):
        if n := counts[length] - plan.placed[length]:
            plan.best_fit(length, n)
    return plan


def plan_of(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """From length -> number of pieces: sorted keys (length << SHIFT | first rank) and, for each, (first sequence, pieces in
    each sequence, offset)."""
    counts = {int(k): int(v) for k, v in histogram.items()}
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    best = None
    for groups in GROUPS:
        plan = plan_with(counts, capacity, groups)
        best = plan if best is None or plan.n < best.n else best
        if best.n == least:
            break
    runs = sorted(best.runs)
    keys = np.array([r[0] << SHIFT | r[1] for r in runs], np.int64)
    return keys, np.array([r[2:] for r in runs], np.int64).reshape(-1, 3)


# ---- the Spark job -------------------------------------------------------------------------------------------------------


# The normalizer and the cutting of texts for which words can be encoded one by one.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTTING = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


#: Latin letters and digits after lower-casing, and what the tokenizer takes for white space among such texts.
ALPHA, DIGIT, SPACE = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾", r" \t\n\x0b\x0c\r\x85\xa0"
#: Signs of other texts, and the four that str.split() takes for white space and the tokenizer does not.
OTHER = re.compile(r"[^\x00-\x1b\x20-\u024f]").search
WORDS = re.compile(rf"[{ALPHA}]+|'s|'t|'re|'ve|'m|'ll|'d|[{DIGIT}]|[^{SPACE}{ALPHA}{DIGIT}]+").findall
#: Whether a full stop or comma has another mark beside it.
MARK = f"[^{SPACE}{ALPHA}{DIGIT}]"
MARKS = re.compile(f"{MARK}(?:(?<=[.,]){MARK}|[.,])").search
#: Stretches of more signs are not remembered.
LONGEST = 64


def stretches(text: str) -> list[str]:
    """A lower-cased Latin text's parts between white space, with every full stop and comma by itself; its words, if one of
    these belongs to a word of several marks."""
    return WORDS(text) if MARKS(text) else text.replace(".", " . ").replace(",", " , ").split()


class Remembered(dict):
    """Stretch of a text without white space -> its ids. What it lacks it takes from the one before, or else has its words
    encoded, which it remembers too. It refers to nothing that refers to it, so that it goes with its task."""

    def __init__(self, tokenize: Callable, signs: dict[int, str], before: dict[str, bytes]):
        self.tokenize, self.signs, self.before = tokenize, signs, before

    def __missing__(self, stretch: str) -> bytes:
        ids = self.before.get(stretch)
        if ids is None:
            words = [stretch] if stretch.isalpha() else WORDS(stretch)
            if len(words) > 1:
                ids = b"".join(map(self.__getitem__, words))
            else:
                signs = stretch if stretch.isascii() and stretch.isprintable() else stretch.translate(self.signs)
                ids = array("I", [t.id for t in self.tokenize(signs)]).tobytes()
        if len(stretch) <= LONGEST:
            self[stretch] = ids
        return ids

    def next(self) -> Remembered:
        """An empty one that takes from this one; what this one could take from is let go."""
        self.before = {}
        return Remembered(self.tokenize, self.signs, self)


class Encoder:
    """Ids of whole texts by a tokenizers file, as 32-bit numbers in the machine's (little-endian) order. If the file says that
    texts are lower-cased, white space is dropped and words are encoded each for itself (NORMALIZER, CUTTING), texts of Latin
    letters are cut at white space here and each worker remembers the ids of recent stretches and their words; any other text,
    and one with a special string, goes whole to the library, as do all texts for any other tokenizer.

    Beyond NUMBERED / 2 stretches a new memory is begun, and the full one is kept until that is full too: what is in use stays,
    and two memories hold NUMBERED, and a batch's, at most."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # What the file says of a part is the part's pickled state; the file itself, which is large, is not read again.
        normalizer, cutting = (json.loads(x.__getstate__()) if x else {} for x in (self.model.normalizer, self.model.pre_tokenizer))
        parts = normalizer.get("normalizers"), cutting.get("pretokenizers")
        self.by_words = parts == (NORMALIZER, CUTTING) and not self.model.post_processor and not self.model.model.dropout
        # Byte-level vocabularies write each byte as a printable sign: its own, or one from 256 on for the others.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
        signs = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        self.known = Remembered(self.model.model.tokenize, {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0x250)}, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > NUMBERED // 2:
            self.known = self.known.next()
        small = [x.lower() for x in texts]
        plain = [self.by_words and not OTHER(s) and not any(t in x for t in self.special) for x, s in zip(texts, small, strict=True)]
        rest = iter(self.model.encode_batch_fast([x for x, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [b"".join(map(self.known.__getitem__, stretches(s))) if p else array("I", next(rest).ids).tobytes() for s, p in zip(small, plain, strict=True)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32, salt of each piece: a text's ids, then end_id, cut only if longer than the capacity."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, salt = Encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        end, most = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                rows, at = [], []
                for i, ids in enumerate(encoder.encode(part.column("text").to_pylist())):
                    ids += end
                    for j, start in enumerate(range(0, len(ids), most)):
                        own = ids[start : start + most]
                        at.append(i)
                        rows.append((j, start // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(range(salt, salt + len(at)), pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "salt"])
                salt += len(at)

    return base.mapInArrow(cut, f"id {dict(base.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, salt long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into few sequences of at most `capacity` tokens; one row per piece: id_col, piece (int), start, length,
    ids_crc32, sequence_id, offset (long).

    Pieces of a length get their rank in parts (by a salt that each stored piece has, so that a length with a third of all
    rows, or a row that is repeated, is ranked by many tasks) and the parts' sums; the rank's run in the plan says the sequence and the offset. Token ids are made once, and
    only their checksums stay.

    Null or empty text: one piece with end_id alone. Repeated rows are packed each. Null ids stay null. An empty table gives
    no rows. A text longer than the capacity is cut; no other is. Other columns are ignored."""
    cut = staged(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    keys, runs = plan_of(histogram, capacity)
    parts = max(PARTS, -(-sum(histogram.values()) // RANKED))

    cut = cut.withColumn("part", F.pmod(F.xxhash64("salt"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32"))
    ranked = cut.withColumn("within", within).join(sums.hint("merge"), ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, length << SHIFT | rank, side="right") - 1
            i = rank - (keys[run] & ((1 << SHIFT) - 1))
            first, each, offset = runs[run].T
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(first + i // each), pa.array(offset + i % each * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(assign, f"id {dict(cut.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
