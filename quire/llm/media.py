"""Media columns: TIFF files in a binary column. A reader that gives one row per page, and a writer to store samples."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Stored pages have rows of 64 samples and at most so many rows.
WIDTH, ROWS = 64, 256
#: Bytes of texts or files that a worker takes from a batch at once.
TOGETHER = 1 << 23
#: How many bytes one stored byte can stand for at most, so that a damaged header can't ask for more memory than its strips fill.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2_600, DEFLATE: 1_040, OLD_DEFLATE: 1_040}


# ---- codecs --------------------------------------------------------------------------------------------------------------


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits that widen one code early, 256 clears and 257 ends."""
    codes, table, free, width = ["100000000"], {}, 258, 9
    current = -1
    for byte in data:
        if current < 0:
            current = byte
            continue
        key = current << 8 | byte
        nxt = table.get(key)
        if nxt is not None:
            current = nxt
            continue
        codes.append(f"{current:0{width}b}")
        table[key] = free
        free += 1
        if free == 4095:
            codes.append(f"{256:0{width}b}")
            table, free, width = {}, 258, 9
        elif free >= 1 << width:
            width += 1
        current = byte
    if current >= 0:
        codes.append(f"{current:0{width}b}")
        if free + 1 >= 1 << width and width < 12:
            width += 1
    codes.append(f"{257:0{width}b}")
    bits = "".join(codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def lzw_decode(data: bytes, most: int) -> bytes:
    bits = bin(int.from_bytes(b"\x01" + data, "big"))[3:]
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, at, size, last = list(single), [], 9, 0, 0, None
    while at + width <= len(bits) and size < most:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 256:
            table, width, last = list(single), 9, None
            continue
        if code == 257:
            break
        if last is None:
            text = table[code]
        else:
            if code < len(table):
                text = table[code]
            elif code == len(table):
                text = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(last + text[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(text)
        size += len(text)
        last = text
    return b"".join(out)


_runs = re.compile(rb"(.)\1{2,127}", re.DOTALL).finditer


def packbits_encode(row: bytes) -> bytes:
    out, at = [], 0

    def literal(part: bytes) -> None:
        for k in range(0, len(part), 128):
            out.append(bytes([len(part[k : k + 128]) - 1]) + part[k : k + 128])

    for m in _runs(row):
        literal(row[at : m.start()])
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(row[at:])
    return b"".join(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    out, at, size = [], 0, 0
    while at < len(data) and size < most:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part = b""
            at += 1
        out.append(part)
        size += len(part)
    return b"".join(out)


def decoded(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    return packbits_decode(data, most)


# ---- reader --------------------------------------------------------------------------------------------------------------

_SIZES = {1: "B", 3: "H", 4: "I"}


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The image directories in turn, each as tag -> values; only the integer types that images need."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a ring")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {0: [order == ">"]}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in _SIZES:
                form = f"{order}{count}{_SIZES[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = list(struct.unpack_from(form, data, place))
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def page_of(data: bytes, tags: dict[int, list[int]]) -> dict:
    """Width, height, samples, bits, compression, predictor, tiled and the bytes of one page's pixels, row by row."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    compression, predictor, tiled = one(259, 1), one(317, 1), 322 in tags
    if bits not in (8, 16) or len(set(tags.get(258, [8]))) > 1 or one(284, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only chunky pages of 8 or 16 bits, with predictor 1 or 2")
    if one(266, 1) != 1:
        raise ValueError("bits in reverse order")
    if compression not in EXPANSION:
        raise ValueError(f"compression {compression} is not supported")
    if not 0 < width * height * samples * (bits // 8) <= EXPANSION[compression] * min(sum(tags[325 if tiled else 279]), len(data)):
        raise ValueError("page size out of range")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(">u2" if one(0, 0) else "<u2")
    if tiled:
        w, h, offsets, sizes = one(322, 0), one(323, 0), tags[324], tags[325]
    else:
        w, h, offsets, sizes = width, min(one(278, height), height), tags[273], tags[279]
    if not w or not h:
        raise ValueError("empty strips or tiles")
    across = -(-width // w)
    image = np.zeros((height, width, samples), kind)
    for k in range(across * -(-height // h)):
        top, left = k // across * h, k % across * w
        rows = h if tiled else min(h, height - top)
        raw = decoded(data[offsets[k] : offsets[k] + sizes[k]], compression, rows * w * samples * kind.itemsize)
        part = np.frombuffer(raw, kind, rows * w * samples).reshape(rows, w, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        image[top : top + rows, left : left + w] = part[: height - top, : width - left]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": image.tobytes()}


def pages_of(data: bytes | None) -> Iterator[tuple[int, dict | None, str | None]]:
    """(page, page_of() or None, error or None) of each page in turn; after an error there are no more."""
    page = -1
    try:
        if data is None:
            raise ValueError("no media")
        for page, tags in enumerate(directories(data)):
            yield page, page_of(data, tags), None
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError, MemoryError) as e:
        yield page + 1, None, str(e) or type(e).__name__


PAGE_FIELDS = {"width": "int", "height": "int", "samples": "int", "bits": "int", "compression": "int", "predictor": "int", "tiled": "boolean", "pixels": "binary"}
_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def tiff_pages(files: DataFrame, media_col: str = "media", batch_bytes: int = 1 << 23) -> DataFrame:
    """One row per page of each TIFF in media_col: all columns of `files` but media_col, then page (int, from 0), width,
    height, samples, bits, compression, predictor, tiled, pixels (binary, row by row) and error.

    Strips or tiles; no compression, LZW, deflate or PackBits; predictor 1 or 2; 8 or 16 bits; either byte order. A file
    that can't be read gives the pages before the fault, then one row with error set and no pixels; the job goes on. A null
    file gives one row with error "no media". Pages of a file follow each other in their order, in the file's partition.
    Columns of `files` that have one of the names above are replaced. No shuffle; pages leave in batches of batch_bytes."""
    names = ["page", *PAGE_FIELDS, "error"]
    kept = [c for c in files.columns if c != media_col and c.lower() not in names]
    head = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c in kept)
    schema = ", ".join([*([head] if kept else []), "page int", *(f"{k} {v}" for k, v in PAGE_FIELDS.items()), "error string"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, size = [], [], 0

            def out(b=b):
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), *(_ARROW[k] for k in PAGE_FIELDS.values()), pa.string()]
                got = pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*kept, *names])
                at.clear()
                rows.clear()
                return got

            for i, data in enumerate(b.column(media_col)):
                for page, image, error in pages_of(data.as_py()):
                    at.append(i)
                    rows.append((page, *(image or dict.fromkeys(PAGE_FIELDS)).values(), error))
                    size += len(rows[-1][-2] or b"")
                    if size >= batch_bytes:
                        yield out()
                        size = 0
            if rows:
                yield out()

    return files.select(*kept, media_col).mapInArrow(read, schema)


# ---- writer --------------------------------------------------------------------------------------------------------------

#: Layouts that stored pages take in turn: compression, predictor, tile width (0: strips), tile or strip height.
LAYOUTS = ((DEFLATE, 2, 0, 64), (PACKBITS, 1, 0, 64), (LZW, 1, 64, 64), (DEFLATE, 2, 32, 32))


def _coded(part: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
    if compression == PACKBITS:
        return b"".join(packbits_encode(row.tobytes()) for row in part)
    return lzw_encode(part.tobytes()) if compression == LZW else zlib.compress(part.tobytes(), 6)


def tiff_of(payload: bytes) -> bytes:
    """The payload (a positive multiple of WIDTH bytes) as 8-bit grey samples of a TIFF; the page's number and the payload's
    checksum choose its layout, so equal payloads give equal files."""
    out, seed = bytearray(b"II*\0\0\0\0\0"), zlib.crc32(payload)
    samples, link = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH), 4
    for page, top in enumerate(range(0, len(samples), ROWS)):
        image = samples[top : top + ROWS]
        compression, predictor, w, h = LAYOUTS[(seed + page) % len(LAYOUTS)]
        offsets, sizes = [], []
        for y in range(0, len(image), h):
            for x in range(0, WIDTH, w or WIDTH):
                part = image[y : y + h, x : x + (w or WIDTH)]
                if w:
                    part = np.pad(part, ((0, h - len(part)), (0, 0)))
                coded = _coded(part, compression, predictor)
                offsets.append(len(out))
                sizes.append(len(coded))
                out += coded + b"\0" * (len(coded) % 2)
        tags = {256: [WIDTH], 257: [len(image)], 258: [8], 259: [compression], 262: [1], 277: [1], 317: [predictor]}
        tags |= {322: [w], 323: [h], 324: offsets, 325: sizes} if w else {273: offsets, 278: [h], 279: sizes}
        entries = b""
        for tag in sorted(tags):
            value = struct.pack(f"<{len(tags[tag])}I", *tags[tag])
            if len(value) > 4:
                place, value = struct.pack("<I", len(out)), value
                out += value
                value = place
            entries += struct.pack("<HHI", tag, 4, len(tags[tag])) + value
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def by_bytes(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about TOGETHER bytes of a column, or of one row that has more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < b.num_rows:
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + TOGETHER, side="right")))
        yield b.slice(first, last - first)
        first = last


def payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, payload: each whole text (null: empty) as UTF-8, with bytes 0 up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    n = F.length(raw)
    size = F.greatest(F.ceil(n / WIDTH), F.lit(1)) * WIDTH
    padded = F.concat(raw, F.unhex(F.repeat(F.lit("00"), (size - n).cast("int"))))
    return docs.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("n_bytes"), padded.alias("payload"))


def store(rows: DataFrame, payload_col: str = "payload") -> DataFrame:
    """payload_col becomes `media`, a TIFF that holds it without loss; null stays null."""
    kept = [c for c in rows.columns if c != payload_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c in kept), "media binary"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, payload_col):
                media = [None if x is None else tiff_of(x) for x in part.column(payload_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(media, pa.binary())], names=[*kept, "media"])

    files = rows.select(*kept, payload_col).mapInArrow(write, schema)
    return files.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))


def feature_of(samples: np.ndarray) -> str:
    """64 bits, one per column of the image: whether its mean is above the image's; then the mean itself."""
    means = samples.reshape(-1, WIDTH).mean(axis=0)
    return f"{np.packbits(means > means.mean()).tobytes().hex()}-{means.mean():.4f}"


FEATURES = "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(files: DataFrame) -> DataFrame:
    """One row per file of store(payloads(...)): the pages are read back from the stored bytes, one after the other; digests of
    all their samples, and features. A file that can't be read fails the job, as it was stored here."""

    def of(data: bytes) -> tuple:
        parts = []
        for _, image, error in pages_of(data):
            if error is not None:
                raise ValueError(f"stored media can't be read: {error}")
            parts.append(image["pixels"])
        payload = b"".join(parts)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature_of(np.frombuffer(payload, np.uint8))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "media"):
                size, sha, crc, feature = zip(*(of(x.as_py()) for x in part.column("media")), strict=True)
                made = {"payload_bytes": pa.array(size, pa.int64()), "payload_sha256": pa.array(sha), "tail_crc32": pa.array(crc, pa.int64()), "feature": pa.array(feature)}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in names], names=names)

    names = [x.split()[0] for x in FEATURES.split(", ")]
    return files.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "media").mapInArrow(read, FEATURES.format(kind=dict(files.dtypes)["doc_id"]))
