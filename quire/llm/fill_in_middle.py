"""Fill-in-middle: texts are cut at two of their boundaries and put in another order, between marks.

A text's boundaries are held as compressed bitmaps hold numbers: the upper bits of an offset name a container of 2^16 offsets,
and a container is a sorted array, a bitmap or runs, whichever takes the least room. Cumulative cardinalities find the container
of the k-th boundary, a selection inside it gives the offset."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text whose outputs leave a worker together.
TOGETHER = 1 << 23


class BoundarySet:
    """Distinct offsets in ascending order; [k] is the k-th, from 0.

    kinds, parts: of each container, in the order of their upper bits (`high`); before: how many offsets lie in those before."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        begins = np.concatenate([[0], cuts]) if len(offsets) else np.zeros(0, np.int64)
        self.high = high[begins]
        self.before = np.concatenate([begins, [len(offsets)]]).astype(np.int64)
        self.kinds, self.parts = [], []
        for low in np.split((offsets & 0xFFFF).astype(np.int32), cuts) if len(offsets) else []:
            first = np.concatenate([[0], np.flatnonzero(np.diff(low) != 1) + 1])
            size = {"array": 2 * len(low), "bitmap": 1 << 13, "runs": 4 * len(first)}
            kind = min(size, key=size.get)
            if kind == "array":
                part = low.astype(np.uint16)
            elif kind == "bitmap":
                bits = np.zeros(1 << 16, bool)
                bits[low] = True
                part = np.packbits(bits, bitorder="little").view(np.uint64)
            else:  # where runs begin, and how many offsets lie in the runs up to each
                part = low[first].astype(np.uint16), np.append(first[1:], len(low)).astype(np.int32)
            self.kinds.append(kind)
            self.parts.append(part)

    def __len__(self) -> int:
        return int(self.before[-1])

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        local, kind, part = k - int(self.before[at]), self.kinds[at], self.parts[at]
        if kind == "array":
            low = part[local]
        elif kind == "bitmap":
            upto = np.cumsum(np.bitwise_count(part), dtype=np.int64)
            word = int(np.searchsorted(upto, local, side="right"))
            bits = np.unpackbits(part[word : word + 1].view(np.uint8), bitorder="little")
            low = 64 * word + np.flatnonzero(bits)[local - (int(upto[word - 1]) if word else 0)]
        else:
            begin, upto = part
            run = int(np.searchsorted(upto, local, side="right"))
            low = int(begin[run]) + local - (int(upto[run - 1]) if run else 0)
        return int(self.high[at]) << 16 | int(low)


def boundaries(text: str, unit: str = "line") -> BoundarySet:
    """Code points before the first unit, after it, after the second, ...: units are lines with their newline, or characters."""
    if unit == "char":
        return BoundarySet(np.arange(len(text) + 1))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    ends = np.append(ends, len(data)) if len(data) and data[-1] != 10 else ends
    if len(data) != len(text) and len(ends):  # bytes to code points
        ends = np.cumsum(np.add.reduceat((data & 0xC0) != 0x80, np.concatenate([[0], ends[:-1]]), dtype=np.int64))
    return BoundarySet(np.concatenate([[0], ends]).astype(np.int64))


def cut(text: str, key: str, unit: str, rate: int, spm_rate: int, marks: tuple[str, str, str]) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text, by the four numbers that the key's digest holds."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    bounds = boundaries(text, unit)
    n = len(bounds) - 1
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = bounds[low], bounds[high]
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n (units of the text), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output.

    `rate` percent of the texts are cut at two boundaries, drawn by the digest of `seed`:id, and `spm_rate` percent of these put
    the suffix first. A text that holds a mark, or is empty, stays plain. unit: "line" (with its newline) or "char".

    Null text: as the empty one, n = 0. A null id is drawn as the empty word. Rows are transformed each for itself: repeated rows
    give equal rows, an empty table none. Other columns are ignored. Marks must not begin with what one of them ends with,
    so that restored() finds the places where they were put."""
    overlap = any(x[-k:] == y[:k] for x in marks for y in marks for k in range(1, min(len(x), len(y))))
    if overlap or not all(marks) or any(a in b for a, b in itertools.permutations(marks, 2)):
        raise ValueError("the marks can't be told apart")
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")
    base = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, size = [], 0, 0
            for k in range(b.num_rows):
                text = b.column("text")[k].as_py()
                rows.append(cut(text, b.column("key")[k].as_py(), unit, rate, spm_rate, marks))
                size += len(text)
                if size > TOGETHER or k == b.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(rows)), *columns], names=names)
                    rows, first, size = [], k + 1, 0

    out = base.mapInArrow(transform, f"id {dict(base.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = (rf"\Q{x}\E" for x in marks)
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
