"""From blocks to chunks: aggregation, repair across pages, headers, splitting."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import CHUNK_MARKS, ends_sentence, is_header, rstrip
from quire.operators.folds import folded
from quire.operators.layout import PAGE

# Sizes of the two chunkers.
MIN_BLOCK, SIZE, OVERLAP = 300, 1500, 150
PARAGRAPH, TAIL, SHORTEST = 800, 150, 20

BLOCK = "struct<text:string,type:string,y_top:double,y_bottom:double,font_size:double,ratio_to_body:double,line_count:int>"
FIELDS = ["text", "type", "y_top", "y_bottom", "font_size", "ratio_to_body", "line_count"]


def aggregate_blocks(blocks: DataFrame, min_chars: int = MIN_BLOCK) -> DataFrame:
    """Consecutive text blocks that aren't headers are joined by newlines until they have min_chars; headers and tables stand
    alone and end what came before. block_id counts from 0 on each page. State is the block that is open."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        open_, size, number = None, 0, 0
        for _, *row, alone, n in rows:
            if alone or open_ is None:
                if open_:
                    yield number, "\n".join(open_[0]), *open_[1:]
                    number, open_ = number + 1, None
                if alone:
                    yield number, *row
                    number += 1
                    continue
                open_, size = [[row[0]] if row[0] is not None else [], *row[1:]], n
            else:
                open_[0] += [row[0]] if row[0] is not None else []
                open_[3], open_[6], size = row[3], open_[6] + row[6], size + n
            if size >= min_chars:
                yield number, "\n".join(open_[0]), *open_[1:]
                number, open_ = number + 1, None
        if open_:
            yield number, "\n".join(open_[0]), *open_[1:]

    alone = F.coalesce((F.col("type") != "text") | is_header(F.col("type"), F.col("ratio_to_body"), F.col("line_count")), F.lit(False))
    rows = blocks.select(*PAGE, "block", "text", "type", *[F.col(c).cast("double").alias(c) for c in FIELDS[2:6]], F.col("line_count").cast("int").alias("line_count"), alone.alias("alone"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    return folded(rows, PAGE, ["block"], [*FIELDS, "alone", "n"], fold, "block_id int, " + BLOCK.removeprefix("struct<").removesuffix(">").replace(":", " "))


def repair_cross_page(blocks: DataFrame) -> DataFrame:
    """A page's last body text that ends no sentence takes over the first body text of the document's next page. A page that
    gave its only body text takes none. Only one small row per page meets in a document's fold; texts are joined back."""
    body = (F.col("type") == "text") & ~is_header(F.col("type"), F.col("ratio_to_body"), F.col("line_count"))
    tagged = blocks.withColumn("body", body)
    pages = tagged.groupBy(*PAGE).agg(
        F.count_if("body").alias("n"), F.min(F.when(F.col("body"), F.col("block"))).alias("first"), F.max(F.when(F.col("body"), F.col("block"))).alias("last"),
        F.max_by(ends_sentence(F.col("text"), CHUNK_MARKS), F.when(F.col("body"), F.col("block"))).alias("ended"))

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        before, last, open_ = None, None, False
        for page, n, first, at, ended in rows:
            moved = open_ and n > 0
            if moved:
                yield page, first, before, last
            before, last, open_ = page, at, n - moved > 0 and not ended

    moves = folded(pages, ("doc",), ["page"], ["n", "first", "last", "ended"], fold, "page long, first int, page_into long, block_into int")
    taken = tagged.join(moves.select("doc", "page", F.col("first").alias("block"), "page_into", "block_into"), ["doc", "page", "block"])
    taken = taken.select("doc", F.col("page_into").alias("page"), F.col("block_into").alias("block"), F.col("text").alias("more"), F.col("line_count").alias("more_lines"))
    rest = tagged.join(moves.select("doc", "page", F.col("first").alias("block")), ["doc", "page", "block"], "left_anti").join(taken, ["doc", "page", "block"], "left")
    text = F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat_ws(" ", rstrip(F.col("text")), F.regexp_replace("more", r"^(?U)\s+", "")))
    return rest.withColumn("text", text).withColumn("line_count", F.col("line_count") + F.coalesce("more_lines", F.lit(0))).drop("more", "more_lines", "body")


def attach_headers(blocks: DataFrame) -> DataFrame:
    """Headers go, joined by newlines, before the next body or table of the document, over page ends too; `header_block_ids`
    are their ids. Headers after the last body become chunks of their own (is_header) on the document's last page."""
    header = is_header(F.col("type"), F.col("ratio_to_body"), F.col("line_count"))
    w = Window.partitionBy("doc").orderBy("page", "block_id")
    before = F.coalesce(F.sum(F.when(~header, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("header", header).withColumn("group", before).withColumn("last_page", F.max("page").over(Window.partitionBy("doc")))
    heads = F.array_sort(F.collect_list(F.when(F.col("header"), F.struct("page", "block_id", "text"))))
    body = F.max(F.when(~F.col("header"), F.struct("page", "block_id", "text", "type")))
    groups = rows.groupBy("doc", "group", "last_page").agg(heads.alias("heads"), body.alias("body"))
    head_text, head_ids = F.array_join(F.transform("heads", lambda h: h["text"]), "\n"), F.transform("heads", lambda h: h["block_id"])
    with_body = groups.where("body is not null").select("doc", F.col("body.page").alias("page"), F.col("body.block_id").alias("block_id"), F.col("body.type").alias("type"), F.lit(False).alias("is_header"),
        F.when(F.size("heads") > 0, F.concat_ws("\n", head_text, F.col("body.text"))).otherwise(F.col("body.text")).alias("text"), head_ids.alias("header_block_ids"))
    alone = groups.where("body is null").select("doc", F.col("last_page").alias("page"), F.explode("heads").alias("h"))
    alone = alone.select("doc", "page", F.col("h.block_id").alias("block_id"), F.lit("header").alias("type"), F.lit(True).alias("is_header"), F.col("h.text").alias("text"), F.array().cast("array<int>").alias("header_block_ids"))
    return with_body.unionByName(alone)


_sentence, _word = re.compile(r"[.!?][ \n]*(?=[^ \n])"), re.compile(r"[^ \n]*[ \n]*")


def split_one(text: str | None, size: int, overlap: int) -> list[str]:
    """Cut at the last blank line, newline or space among the last `overlap` signs of a window of `size`, and start the next
    chunk after a sentence end, or at a word, among the last `overlap` signs. No text is skipped."""
    text, out, start = (text or "").strip(), [], 0
    if len(text) <= size:
        return [text] if text else []
    while len(text) - start > size:
        window = text[start : start + size]
        at = next((x for x in map(window.rfind, ("\n\n", "\n", " ")) if x > 0 and x >= size - overlap), -1)
        cut = at if at > 0 else size
        out.append(window[:cut].rstrip())
        follow = start + cut
        if len(text) - follow > size:
            low = max(start + cut - overlap, start + 1)
            tail = text[low:follow]
            ends = [i for i in (tail.find(m + " ") for m in CHUNK_MARKS) if i >= 0]
            word = tail.find(" ")
            follow = low + min(ends) + 2 if ends else low + word + 1 if word >= 0 else follow
        start = follow
    out.append(text[start:].strip())
    return [x for x in out if x]


def split_with_steps(text: str | None, size: int, overlap: int) -> list[str]:
    """The behaviour to match: cut after the last blank line, else newline, else space of a window, wherever it is; the next chunk
    starts at the first sentence, else word, of the last `overlap` signs, but no sooner than size - overlap on. That step can
    skip text after an early cut."""
    text, out, start = (text or "").strip(), [], 0
    while len(text) - start > size:
        window = text[start : start + size]
        cut = next((at + len(mark) for mark in ("\n\n", "\n", " ") if (at := window.rfind(mark)) > 0), size)
        out.append(window[:cut].rstrip())
        step = cut
        if len(text) - start - cut > size:
            low = max(0, cut - overlap)
            tail = window[low:cut]
            found = _sentence.search(tail) or _word.match(tail)
            follow = low + found.end() if found.end() < len(tail) else low
            step = follow if follow else cut
        start += max(step, size - overlap, 1)
    return [*out, text[start:]] if text[start:] else out


def split_text(text: Column, size: int = SIZE, overlap: int = OVERLAP, lossless: bool = True) -> Column:
    """array<string> of chunks by split_one, or with lossless=False by split_with_steps. Row by row, in Arrow batches: where a chunk
    starts depends on where the one before was cut, and slices of a Python text are cheap, while a fold over the text in
    SQL copies the rest of it at each step."""
    cut = split_one if lossless else split_with_steps

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t, size, overlap))

    return split(text)


def long_windows(text: str) -> list[str]:
    """Windows of PARAGRAPH signs that end at a sentence, newline or space where there is one, TAIL signs shared. Every step
    goes forward: where the shared part would not, the next window starts at the end of this one."""
    out, start = [], 0
    while start < len(text):
        end = start + PARAGRAPH
        if end < len(text):
            found = next((p for p in (text.rfind(m, start, end) for m in (". ", "\n", " ")) if p > start), -1)
            end = found + 1 if found > start else end
        out.append(text[start:end].strip())
        start = end - TAIL if end - TAIL > start else end
    return [x for x in out if x]


def paragraphs(text: str | None) -> list[str]:
    text = text or ""
    if len(text) <= PARAGRAPH:
        return [text.strip()] if text.strip() else []
    out, now = [], ""
    for part in filter(str.strip, text.split("\n\n")):
        if len(now) + len(part) + 2 <= PARAGRAPH:
            now = f"{now}\n\n{part}".strip()
        elif now:
            out.append(now.strip())
            now = f"{now[-TAIL:].lstrip()}\n\n{part}"
        else:
            out += long_windows(part)
    out += [now] if now else []
    return [x for x in map(str.strip, out) if len(x) > SHORTEST]


def split_long(text: Column) -> Column:
    """array<string> of the windows of a paragraph."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: long_windows(t or ""))

    return split(text)


def chunk_paragraphs(text: Column) -> Column:
    """array<string>: paragraphs joined up to PARAGRAPH signs, longer ones cut into windows. Row by row, as split_text is."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(paragraphs)

    return split(text)


def chunk_documents(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Blocks (doc, page, block, text, type, ...) to chunks: chunk_id {doc}_{page}_{block}_{index}, page, text, is_header,
    block_type, header_block_ids (on index 0). Tables stay whole. Trailing headers whose id is taken get a suffix _h{n}."""
    parts = attach_headers(aggregate_blocks(repair_cross_page(blocks)))
    texts = F.when((F.col("type") == "table") | F.col("is_header"), F.array("text")).otherwise(split_text(F.col("text"), size, overlap))
    rows = parts.select("doc", "page", "block_id", "type", "is_header", "header_block_ids", F.posexplode(texts).alias("chunk_idx", "chunk"))
    name = F.concat_ws("_", "doc", "page", "block_id", "chunk_idx")
    again = F.row_number().over(Window.partitionBy("doc", "page", "block_id", "chunk_idx").orderBy("is_header", "chunk")) - 1
    return rows.withColumn("again", again).select(
        "doc", "page", "block_id", "chunk_idx", F.when(F.col("again") > 0, F.concat(name, F.lit("_h"), F.col("again").cast("string"))).otherwise(name).alias("chunk_id"),
        F.col("chunk").alias("text"), "is_header", F.col("type").alias("block_type"), F.when(F.col("chunk_idx") == 0, F.col("header_block_ids")).alias("header_block_ids"))
