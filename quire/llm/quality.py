"""Quality rules: surface counts of each text and a hashed n-gram log-likelihood ratio with a fixed threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, staged
from quire.llm.words import WORDS, WordIds

#: Buckets of the two multinomials; what the driver gets is at most this many rows.
BUCKETS = 1 << 16
#: Occurrences that a bucket must have before its ratio counts: both counts are raised by so many.
SHRINK = 5.0
#: Buckets of texts that a worker holds before it counts them.
HELD = 1 << 17
#: Trusted ids (8 bytes each) that may be broadcast; above it the join shuffles.
BROADCAST_IDS = 2_000_000
SYMBOLS = "#*$%&|<>"
#: Signs of the n-grams: runs of letters and digits, and runs of other marks.
SIGNS = re.compile(r"\w+|[^\w\s]+").findall
SPACES = " \t\n\x0b\x0c\r"


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """Buckets of all unigrams and bigrams of a text, from its signs' hashes."""
    h = hashes.astype(np.uint64)
    one = h * np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x165667B19E3779F9)
    return (np.concatenate([one, two]) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words which occurs twice or more in the text."""
    n = len(ids) - 2
    if n < 2:
        return 0
    top = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)  # pairs are numbered, so that windows fit 64 bits
    _, inverse, count = np.unique(pairs[:-1] * top + ids[2:], return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    twice = count[inverse] > 1
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[k : k + n] |= twice
    return int(inside.sum())


def surface(text: str, words: list[str], ids: np.ndarray) -> tuple[int, int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, ids, held = np.zeros((2, BUCKETS), np.int64), WordIds(), 0
    waiting: tuple[list, list] = ([], [])

    def add() -> None:
        for k, found in enumerate(waiting):
            if found:
                seen[k] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                found.clear()

    for b in batches:
        for text, trusted in zip(b.column("text"), b.column("trusted").to_pylist(), strict=True):
            ids.fresh()
            signs = SIGNS(text.as_py())
            if signs:
                found = buckets_of(ids.hashes_of(ids.of(signs)))
                for k in range(1 + trusted):
                    waiting[k].append(found)
                held += len(found)
            if held > HELD:
                add()
                held = 0
    add()
    at = np.flatnonzero(seen[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], names=["bucket", "n_raw", "n_trusted"])


def llr_table(docs: DataFrame) -> np.ndarray:
    """log(P_trusted / P_raw) of each bucket, from docs (text, trusted): the trusted count over the one to be expected from the
    raw corpus, both raised by SHRINK, so that rare buckets say little and small tables don't judge by chance. Counts are
    summed in each task, then by bucket; the driver gets at most BUCKETS rows. All zeros if no row is trusted."""
    sums = docs.mapInArrow(_count, "bucket long, n_raw long, n_trusted long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_trusted").alias("n_trusted"))
    got = sums.toPandas()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"]], trusted[got["bucket"]] = got["n_raw"], got["n_trusted"]
    if not trusted.sum():
        return np.zeros(BUCKETS)
    return np.log((trusted + SHRINK) / (raw * (trusted.sum() / raw.sum()) + SHRINK))


def quality_rules(docs: DataFrame, trusted: DataFrame | None = None, threshold: float = -0.3, min_words: int = 50, max_repeat_percent: int = 50, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Surface counts and the verdict of each row.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), llr
    (double). `trusted` has the ids (column id_col) of documents whose n-grams make the target multinomial; the raw one is
    made of all rows. llr is the sum of log(P_target / P_raw) over a text's unigrams and bigrams of SIGNS, hashed into BUCKETS
    buckets, divided by their number. kept: not base_failed and llr >= threshold, the same for every row.

    Null or empty text: no words, base_failed, llr 0. Repeated rows are counted and judged each. Null ids are never
    trusted. Without trusted rows every llr is 0. An empty table gives no rows. The columns of `carry` follow unchanged, so that
    each row keeps its own verdict whatever its id; others are ignored, so their names can't clash. A text that is carried
    goes to the workers once.
    """
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry if c != text_col])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))
    back = ["id", "carried", *(["text"] if text_col in carry else [])]
    if trusted is None:
        llr = np.zeros(BUCKETS)
    else:
        ids = staged(trusted.select(F.col(id_col).alias("trusted_id")).where("trusted_id is not null").distinct())
        marked = base.join(broadcast_if_small(ids, ids.count(), BROADCAST_IDS), F.col("id") == F.col("trusted_id"), "left")
        llr = llr_table(marked.select(F.coalesce("text", F.lit("")).alias("text"), F.col("trusted_id").isNotNull().alias("trusted")))
    llr = llr.astype(np.float32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            rows = []
            for x in b.column("text"):
                ids.fresh()
                words, signs = WORDS(text := x.as_py() or ""), SIGNS(text)
                score = float(llr[buckets_of(ids.hashes_of(ids.of(signs)))].mean(dtype=np.float64)) if signs else 0.0
                rows.append((len(words), *surface(text, words, ids.of(words)), score))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in back), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64())], names=[*back, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    kinds = dict(base.dtypes)
    out = base.mapInArrow(judge, f"{', '.join(f'{c} {kinds[c]}' for c in back)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr", *[(F.col("text") if c == text_col else F.col("carried")[c]).alias(c) for c in carry])
