"""Text functions of columns: right-to-left repair, headers, labels and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Hebrew block, its final letters, marks that end a sentence in chunking and in layout, and the ratio of a
# header's font to the body's.
HEBREW = "[֐-׿]"
FINAL = "[םןץךף]"
CHUNK_MARKS = [".", "!", "?"]
LAYOUT_MARKS = [".", "!", "?", "׃", "״"]
HEADER_RATIO = 1.2
#: White space as str.strip() sees it.
SPACE = r"(?U)\s"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+$", "")


def count_of(c: Column, pattern: str) -> Column:
    return F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))


def is_hebrew_text(c: Column) -> Column:
    """Stripped length of 2 or more, and 15 % or more of the signs that aren't white space are Hebrew."""
    dense = F.regexp_replace(c, SPACE, "")
    return (F.char_length(strip(c)) >= 2) & (F.char_length(dense) > 0) & (count_of(dense, HEBREW) >= 0.15 * F.char_length(dense))


def tokens(c: Column) -> Column:
    """Words and the white space between them, in turn."""
    return F.regexp_extract_all(c, F.lit(rf"{SPACE}+|(?U)\S+"), F.lit(0))


def looks_reversed(c: Column) -> Column:
    """Of at least five words with two Hebrew letters or more, over 15 % begin with a final letter."""
    words = F.filter(F.split(strip(c), rf"{SPACE}+"), lambda w: count_of(w, HEBREW) >= 2)
    first = F.filter(words, lambda w: F.regexp_extract(w, HEBREW, 0).rlike(FINAL))
    return (F.size(words) >= 5) & (F.size(first) > 0.15 * F.size(words))


def fix_reversed_words(c: Column) -> Column:
    """Turn round each word without Latin letters that has two Hebrew letters or more, at least half of its signs, and at most
    40 % digits; white space stays."""

    def fixed(w: Column) -> Column:
        n, hebrew = F.char_length(w), count_of(w, HEBREW)
        wrong = ~w.rlike("[A-Za-z]") & (hebrew >= 2) & (hebrew >= 0.5 * n) & (count_of(w, r"(?U)\d") <= 0.4 * n)
        return F.when(wrong, F.reverse(w)).otherwise(w)

    return F.array_join(F.transform(tokens(c), fixed), "")


def fix_word_order(c: Column) -> Column:
    """The words in reverse; runs of white space keep their places."""
    parts = F.regexp_extract_all(c, F.lit(rf"{SPACE}+|(?U)\S+"), F.lit(0))
    words = F.reverse(F.filter(parts, lambda p: ~p.rlike(rf"^{SPACE}")))
    lead = F.when(c.rlike(rf"^{SPACE}"), 1).otherwise(0)
    at = lambda i: F.floor((i - lead) / 2).cast("int")
    return F.array_join(F.transform(parts, lambda p, i: F.when(p.rlike(rf"^{SPACE}"), p).otherwise(F.get(words, at(i)))), "")


def ends_sentence(c: Column, marks: list[str] = CHUNK_MARKS) -> Column:
    return F.coalesce(F.right(rstrip(c), F.lit(1)).isin(marks), F.lit(False))


def is_header(kind: Column, ratio: Column, line_count: Column) -> Column:
    return (kind == "header") | ((kind == "text") & (ratio >= HEADER_RATIO) & (line_count <= 2))


def promoted(kind: Column, ratio: Column, line_count: Column) -> Column:
    return F.when((ratio >= HEADER_RATIO) & (line_count <= 2), "header").otherwise(kind)


def classify_file_type(name: Column) -> Column:
    n = F.lower(name)
    out = F.when(n.endswith(".pdf"), "pdf").when(n.endswith(".docx"), "docx")
    out = out.when(n.endswith(".geojson") | n.endswith(".json"), "geojson").when(n.endswith(".shp") | n.endswith(".shapefile"), "shapefile")
    return out.otherwise("pdf")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "success").when(score >= 50, "warning").otherwise("destructive")


def file_size_label(n: Column) -> Column:
    label = lambda power, unit: F.format_string(f"%.1f {unit}", n / float(1024**power))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, label(1, "KB")).when(n < 1024**3, label(2, "MB")).otherwise(label(3, "GB"))


def object_key(workspace: Column, file: Column, name: Column) -> Column:
    return F.concat_ws("/", workspace, file, F.coalesce(name, F.lit("file")))


def split_answer_footer(answer: Column, marker: str) -> tuple[Column, Column]:
    """Body and footer at the last occurrence of the marker; without it all is body and the footer is null."""
    has = F.instr(answer, marker) > 0
    footer = F.substring_index(answer, marker, -1)
    body = F.substring(answer, F.lit(1), F.char_length(answer) - F.char_length(footer) - len(marker))
    return F.when(has, body).otherwise(answer), F.when(has, footer)
