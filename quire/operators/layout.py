"""From word boxes to lines, blocks and pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import HEADER_RATIO, LAYOUT_MARKS, ends_sentence, fix_reversed_words, fix_word_order, is_hebrew_text, looks_reversed, promoted, rstrip
from quire.operators.folds import folded

# Gap between lines; how far fonts may differ; how many font sizes a gap may be, inside and after a sentence.
LINE_GAP = 3.0
MERGE = {"v2": {"font": 3.0, "open": 4.2, "closed": 2.8, "headers": True}, "v1": {"font": 1.5, "open": 1.5, "closed": 1.5, "headers": False}}
PAGE = ("doc", "page")


def words_outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words whose box lies in no table box of the page."""
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in (*PAGE, "x0", "top", "x1", "bottom")])
    inside = (F.col("doc") == F.col("t_doc")) & (F.col("page") == F.col("t_page"))
    inside &= (F.col("x0") >= F.col("t_x0")) & (F.col("top") >= F.col("t_top")) & (F.col("x1") <= F.col("t_x1")) & (F.col("bottom") <= F.col("t_bottom"))
    return words.join(t, inside, "left_anti")


def page_font_stats(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(F.round(F.median("size"), 2).alias("median_font_size"), F.round(F.max("size"), 2).alias("max_font_size"))


def assign_lines(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """`line` from 0: a new one where the top differs by `gap` or more from that of the word before, in reading order."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    new = F.coalesce((F.abs(F.col("top") - F.lag("top").over(w)) >= gap).cast("int"), F.lit(0))
    return words.withColumn("new", new).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def lines_from_words(words: DataFrame) -> DataFrame:
    """One row per line of assign_lines: text, font_size, y_top, y_bottom, ratio_to_body. The page's median is worked out where the
    words of a page are together already, so that they are not shuffled again."""
    words = words.withColumn("median_font_size", F.round(F.median("size").over(Window.partitionBy(*PAGE)), 2))
    lines = words.groupBy(*PAGE, "line", "median_font_size").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.round(F.max("size"), 2).alias("font_size"), F.round(F.min("top"), 2).alias("y_top"), F.round(F.max("bottom"), 2).alias("y_bottom"),
    )
    ratio = F.when(F.col("median_font_size") > 0, F.round(F.col("font_size") / F.col("median_font_size"), 2)).otherwise(1.0)
    return lines.withColumn("ratio_to_body", ratio).drop("median_font_size")


def lines_from_ocr_words(words: DataFrame) -> DataFrame:
    """Words of an OCR engine (block, par, line) as lines: blank words go, the font is the mean height, lines go by their top."""
    keys = [*PAGE, "block_num", "par_num", "line_num"]
    lines = words.where(F.trim("text") != "").groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.round(F.avg("height"), 2).alias("font_size"), F.min("top").alias("y_top"), F.max(F.col("top") + F.col("height")).alias("y_bottom"),
    )
    w = Window.partitionBy(*PAGE).orderBy("y_top", "block_num", "par_num", "line_num")
    return lines.withColumn("line", F.row_number().over(w) - 1).drop("block_num", "par_num", "line_num")


def repair_rtl_lines(lines: DataFrame) -> DataFrame:
    """Reversed Hebrew words and their order are put right in lines that look reversed, or whose page does."""
    pages = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("whole"))
    flags = pages.select(*PAGE, (is_hebrew_text(F.col("whole")) & looks_reversed(F.col("whole"))).alias("page_reversed"))
    c = F.col("text")
    wrong = is_hebrew_text(c) & (F.col("page_reversed") | looks_reversed(c))
    return lines.join(flags, list(PAGE)).withColumn("text", F.when(wrong, fix_word_order(fix_reversed_words(c))).otherwise(c)).drop("page_reversed")


def promote_header(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("type", promoted(F.col("type"), F.col("ratio_to_body"), F.col("line_count")))


def merge_lines(lines: DataFrame, variant: str = "v2") -> DataFrame:
    """Lines into blocks: doc, page, block (from 0), text, type, y_top, y_bottom, font_size, ratio_to_body, line_count. A line
    joins the block if its font is close to the block's first line and it starts close below the last one; headers stand
    alone (v2). State is the block that is open."""
    p = MERGE[variant]

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        texts: list[str] = []
        top = bottom = font = ratio = 0.0
        ended = n = 0
        for _, text, y_top, y_bottom, size, r, ends, blank in rows:
            reach = p["closed"] if variant != "v1" and (ended or (n == 1 and texts == [""])) else p["open"]
            near = abs(size - font) < p["font"] if variant == "v1" else abs(size - font) <= p["font"]
            joins = n and near and y_top - bottom < font * reach and not (p["headers"] and (r >= HEADER_RATIO or ratio >= HEADER_RATIO))
            if n and not joins:
                yield " ".join(texts), top, bottom, font, ratio, n
            if not joins:
                texts, top, font, ratio, n, ended = [], y_top, size, r, 0, False
            texts += [text] if text is not None else []
            bottom, n, ended = y_bottom, n + 1, ended if blank else ends
        if n:
            yield " ".join(texts), top, bottom, font, ratio, n

    c = F.col("text")
    rows = lines.select(*PAGE, "line", "text", *[F.col(c).cast("double").alias(c) for c in ("y_top", "y_bottom", "font_size", "ratio_to_body")], ends_sentence(c, LAYOUT_MARKS).alias("ends"), F.coalesce(rstrip(c) == "", F.lit(True)).alias("blank"))
    blocks = folded(rows, PAGE, ["line"], ["text", "y_top", "y_bottom", "font_size", "ratio_to_body", "ends", "blank"], fold, "text string, y_top double, y_bottom double, font_size double, ratio_to_body double, line_count int")
    blocks = blocks.withColumn("type", F.lit("text"))
    blocks = promote_header(blocks) if variant == "v2" else blocks
    return sort_blocks_by_position(blocks)


def sort_blocks_by_position(blocks: DataFrame) -> DataFrame:
    """`block`: the place on the page from 0, by y_top."""
    return blocks.withColumn("block", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y_top", "y_bottom", "text")) - 1)


def table_markdown(cells: DataFrame) -> DataFrame:
    """Cells (doc, page, table, row, col, value) as Markdown: a header row, a rule, the other rows; null is empty."""
    keys = [*PAGE, "table"]
    values = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"])
    rows = cells.groupBy(*keys, "row").agg(values.alias("values"))
    line = F.concat(F.lit("| "), F.array_join("values", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("values", lambda v: F.lit("---")), " | "), F.lit(" |"))
    rows = rows.select(*keys, "row", line.alias("line"), rule.alias("rule"))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "line", "rule"))).alias("r"))
    body = F.transform("r", lambda x, i: F.when(i == 0, F.concat_ws("\n", x["line"], x["rule"])).otherwise(x["line"]))
    return out.select(*keys, F.array_join(body, "\n").alias("markdown"))


def merge_block_sources(table_blocks: DataFrame, text_blocks: DataFrame) -> DataFrame:
    return sort_blocks_by_position(table_blocks.unionByName(text_blocks, allowMissingColumns=True))


def layout_documents(words: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Words to blocks: tables' words go, lines are built and put right, lines become blocks. Pages without words are absent."""
    words = words if tables is None else words_outside_tables(words, tables)
    return merge_lines(repair_rtl_lines(lines_from_words(assign_lines(words))))
