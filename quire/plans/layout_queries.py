"""Queries over word boxes, lines, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking as K
from quire.operators import layout as L
from quire.plans.fixtures import query

LINED = """lined AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY doc, page ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS line
  FROM (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY doc, page ORDER BY seq)) >= 3 THEN 1 ELSE 0 END AS new FROM words)),
stats AS (SELECT doc, page, round(median(size), 2) AS med, round(max(size), 2) AS most FROM words GROUP BY doc, page),
lns AS (SELECT l.doc, l.page, CAST(l.line AS BIGINT) AS line, string_agg(text, ' ' ORDER BY seq) AS text, round(max(size), 2) AS font_size, round(min(top), 2) AS y_top, round(max(bottom), 2) AS y_bottom,
  CASE WHEN med > 0 THEN round(round(max(size), 2) / med, 2) ELSE 1.0 END AS ratio_to_body FROM lined l JOIN stats s ON l.doc = s.doc AND l.page = s.page GROUP BY l.doc, l.page, l.line, med)"""
HEAD = "(type = 'text' AND ratio_to_body >= 1.2 AND line_count <= 2)"


@query("SELECT doc, seq FROM words w WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.doc = w.doc AND t.page = w.page AND w.x0 >= t.x0 AND w.top >= t.top AND w.x1 <= t.x1 AND w.bottom <= t.bottom)")
def words_outside_tables(v):
    return L.words_outside_tables(v.words, v.tables).select("doc", "seq")


@query("SELECT doc, page, round(median(size), 2) AS median_font_size, round(max(size), 2) AS max_font_size FROM words GROUP BY doc, page")
def page_font_stats(v):
    return L.page_font_stats(v.words)


@query(f"WITH {LINED} SELECT doc, seq, CAST(line AS BIGINT) AS line FROM lined")
def assign_lines(v):
    return L.assign_lines(v.words).select("doc", "seq", "line")


@query(f"WITH {LINED} SELECT * FROM lns")
def lines_from_words(v):
    return L.lines_from_words(L.assign_lines(v.words))


@query("""SELECT doc, page, text, font_size, y_top, y_bottom, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY y_top, block_num, par_num, line_num) - 1 AS INT) AS line FROM (
  SELECT doc, page, block_num, par_num, line_num, string_agg(trim(text), ' ' ORDER BY seq) AS text, round(avg(height), 2) AS font_size, min(top) AS y_top, max(top + height) AS y_bottom
  FROM ocr_words WHERE trim(text) <> '' GROUP BY doc, page, block_num, par_num, line_num)""")
def lines_from_ocr_words(v):
    return L.lines_from_ocr_words(v.ocr_words)


def _merge(font: str, reach: str, extra: str, before: str = "", lined: str = LINED, more: str = "") -> str:
    return f"""WITH RECURSIVE {before}{lined},
m AS (SELECT doc, page, line, 0 AS block, text, y_top, y_bottom, font_size, ratio_to_body, 1 AS line_count, y_top AS last_top FROM lns WHERE line = 0
  UNION ALL SELECT n.doc, n.page, n.line, CASE WHEN ok THEN block ELSE block + 1 END, CASE WHEN ok THEN concat(m.text, ' ', n.text) ELSE n.text END, CASE WHEN ok THEN m.y_top ELSE n.y_top END, n.y_bottom,
  CASE WHEN ok THEN m.font_size ELSE n.font_size END, CASE WHEN ok THEN m.ratio_to_body ELSE n.ratio_to_body END, CASE WHEN ok THEN m.line_count + 1 ELSE 1 END, n.y_top
  FROM (SELECT m.*, n.line AS nline, ({font} AND n.y_top - m.y_bottom < m.font_size * {reach} {extra}) AS ok FROM m JOIN lns n ON m.doc = n.doc AND m.page = n.page AND n.line = m.line + 1) m
  JOIN lns n ON m.doc = n.doc AND m.page = n.page AND n.line = m.nline)
SELECT doc, page, text, y_top, y_bottom, font_size, ratio_to_body, CAST(line_count AS INT) AS line_count{more} FROM m QUALIFY row_number() OVER (PARTITION BY doc, page, block ORDER BY line DESC) = 1"""


V2 = ("abs(n.font_size - m.font_size) <= 3.0", "CASE WHEN right(rtrim(m.text), 1) IN ('.', '!', '?') THEN 2.8 ELSE 4.2 END", "AND n.ratio_to_body < 1.2 AND m.ratio_to_body < 1.2")
OUTSIDE = "SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.doc = w.doc AND t.page = w.page AND w.x0 >= t.x0 AND w.top >= t.top AND w.x1 <= t.x1 AND w.bottom <= t.bottom)"


@query(_merge(*V2))
def merge_lines(v):
    return L.merge_lines(L.lines_from_words(L.assign_lines(v.words))).select("doc", "page", "text", "y_top", "y_bottom", "font_size", "ratio_to_body", "line_count")


@query(_merge("abs(n.font_size - m.font_size) < 1.5", "1.5", ""))
def merge_lines_v1(v):
    return L.merge_lines(L.lines_from_words(L.assign_lines(v.words)), "v1").select("doc", "page", "text", "y_top", "y_bottom", "font_size", "ratio_to_body", "line_count")


@query(f"SELECT doc, page, block, CASE WHEN {HEAD} OR (ratio_to_body >= 1.2 AND line_count <= 2) THEN 'header' ELSE type END AS type FROM blocks")
def promote_header(v):
    return L.promote_header(v.blocks).select("doc", "page", "block", "type")


@query(f"SELECT doc, page, block, {HEAD} AS header FROM blocks")
def is_header(v):
    return v.blocks.select("doc", "page", "block", T.is_header(F.col("type"), F.col("ratio_to_body"), F.col("line_count")).alias("header"))


@query("SELECT doc, page, block, coalesce(right(rtrim(text), 1) IN ('.', '!', '?'), false) AS ended FROM blocks")
def ends_sentence(v):
    return v.blocks.select("doc", "page", "block", T.ends_sentence(F.col("text")).alias("ended"))


@query("SELECT doc, page, block AS old, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY y_top, y_bottom, text) - 1 AS INT) AS block FROM blocks")
def sort_blocks_by_position(v):
    return L.sort_blocks_by_position(v.blocks.withColumnRenamed("block", "old")).select("doc", "page", "old", "block")


@query("SELECT doc, page, type, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY y_top, y_bottom, text) - 1 AS INT) AS block FROM blocks")
def merge_block_sources(v):
    b = v.blocks.drop("block")
    return L.merge_block_sources(b.where("type = 'table'"), b.where("type = 'text'")).select("doc", "page", "type", "block")


@query("""SELECT n_regionkey AS doc, 1 AS page, 0 AS "table", string_agg(CASE WHEN n = 0 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY n) AS markdown FROM (
  SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n, '| ' || n_name || ' | ' || CASE WHEN n_nationkey = 3 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END || ' |' AS line FROM nation) GROUP BY n_regionkey""")
def table_markdown(v):
    cells = v.table("nation").select(F.col("n_regionkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("table"), F.col("n_nationkey").alias("row"),
        F.inline(F.array(F.struct(F.lit(0).alias("col"), F.col("n_name").alias("value")), F.struct(F.lit(1).alias("col"), F.when(F.col("n_nationkey") != 3, F.col("n_nationkey").cast("string")).alias("value")))))
    return L.table_markdown(cells)


# Hebrew in SQL: letters of a text, a text without white space, the rules for texts, words and lines.
def _letters(t: str, of: str = "[֐-׿]") -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{of}', '', 'g')))"


_DENSE = r"regexp_replace({0}, '\s', '', 'g')"
IS_HEBREW = "(length(trim({0})) >= 2 AND length(%s) > 0 AND %s >= 0.15 * length(%s))" % (_DENSE, _letters(_DENSE), _DENSE)
_heb_words = "list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: %s >= 2)" % _letters("w")
LOOKS_REVERSED = "(len(%s) >= 5 AND len(list_filter(%s, lambda w: regexp_matches(regexp_extract(w, '[֐-׿]'), '[םןץףך]'))) > 0.15 * len(%s))" % (_heb_words, _heb_words, _heb_words)
_parts = "regexp_extract_all({0}, '\\s+|\\S+')"
FIX_WORDS = "array_to_string(list_transform(%s, lambda w: CASE WHEN NOT regexp_matches(w, '[A-Za-z]') AND %s >= 2 AND %s >= 0.5 * length(w) AND %s <= 0.4 * length(w) THEN reverse(w) ELSE w END), '')" % (_parts, _letters("w"), _letters("w"), _letters("w", "[0-9]"))
_turned = "list_reverse(list_filter(%s, lambda p: NOT regexp_matches(p, '^\\s')))" % _parts
FIX_ORDER = "array_to_string(list_transform(%s, lambda p, i: CASE WHEN regexp_matches(p, '^\\s') THEN p ELSE list_extract(%s, CAST(floor((i - 1 - CASE WHEN regexp_matches({0}, '^\\s') THEN 1 ELSE 0 END) / 2) AS BIGINT) + 1) END), '')" % (_parts, _turned)


@query(f"SELECT id, {IS_HEBREW.format('text')} AS hebrew FROM hebrew")
def is_hebrew_text(v):
    return v.hebrew.select("id", T.is_hebrew_text(F.col("text")).alias("hebrew"))


@query(f"SELECT id, {LOOKS_REVERSED.format('text')} AS turned FROM hebrew")
def looks_reversed(v):
    return v.hebrew.select("id", T.looks_reversed(F.col("text")).alias("turned"))


@query(f"SELECT id, {FIX_WORDS.format('text')} AS text FROM hebrew")
def fix_reversed_words(v):
    return v.hebrew.select("id", T.fix_reversed_words(F.col("text")).alias("text"))


@query(f"SELECT id, {FIX_ORDER.format('text')} AS text FROM hebrew")
def fix_word_order(v):
    return v.hebrew.select("id", T.fix_word_order(F.col("text")).alias("text"))


@query(f"""WITH pg AS (SELECT doc, page, string_agg(text, ' ' ORDER BY line) AS whole FROM hebrew GROUP BY doc, page),
marked AS (SELECT h.*, {IS_HEBREW.format('h.text')} AND ({IS_HEBREW.format('whole')} AND {LOOKS_REVERSED.format('whole')} OR {LOOKS_REVERSED.format('h.text')}) AS wrong, {FIX_WORDS.format('h.text')} AS fixed FROM hebrew h JOIN pg ON h.doc = pg.doc AND h.page = pg.page)
SELECT id, doc, page, line, CASE WHEN wrong THEN {FIX_ORDER.format('fixed')} ELSE text END AS text FROM marked""")
def repair_rtl_lines(v):
    return L.repair_rtl_lines(v.hebrew).select("id", "doc", "page", "line", "text")


@query(_merge(*V2, before=f"outside AS ({OUTSIDE}), ", lined=LINED.replace("FROM words", "FROM outside"), more=", CASE WHEN ratio_to_body >= 1.2 AND line_count <= 2 THEN 'header' ELSE 'text' END AS type"))
def layout_documents(v):
    return L.layout_documents(v.words, v.tables).drop("block")


@query(f"""WITH RECURSIVE src AS (SELECT *, {HEAD} OR type <> 'text' AS alone FROM blocks),
m AS (SELECT doc, page, block, 0 AS block_id, text, alone, CASE WHEN alone OR length(text) >= 300 THEN 1 ELSE 0 END AS shut, length(text) AS size, line_count FROM src WHERE block = 0
  UNION ALL SELECT n.doc, n.page, n.block, CASE WHEN shut = 1 OR n.alone THEN block_id + 1 ELSE block_id END, CASE WHEN shut = 1 OR n.alone THEN n.text ELSE concat(m.text, chr(10), n.text) END, n.alone,
  CASE WHEN n.alone OR (CASE WHEN shut = 1 THEN 0 ELSE m.size END) + length(n.text) >= 300 THEN 1 ELSE 0 END, CASE WHEN shut = 1 OR n.alone THEN length(n.text) ELSE m.size + length(n.text) END, CASE WHEN shut = 1 OR n.alone THEN n.line_count ELSE m.line_count + n.line_count END
  FROM m JOIN src n ON m.doc = n.doc AND m.page = n.page AND n.block = m.block + 1)
SELECT doc, page, CAST(block_id AS INT) AS block_id, text, CAST(line_count AS INT) AS line_count FROM m QUALIFY row_number() OVER (PARTITION BY doc, page, block_id ORDER BY block DESC) = 1""")
def aggregate_blocks(v):
    return K.aggregate_blocks(v.blocks).select("doc", "page", "block_id", "text", "line_count")


@query("SELECT doc, page, block, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY block) - 1 AS INT) AS block_id FROM blocks")
def number_blocks(v):
    from pyspark.sql import Window

    return v.blocks.select("doc", "page", "block", (F.row_number().over(Window.partitionBy("doc", "page").orderBy("block")) - 1).alias("block_id"))


@query(f"""WITH RECURSIVE b AS (SELECT *, type = 'text' AND NOT {HEAD} AS body FROM blocks),
p AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS i, count(*) FILTER (WHERE body) AS n, min(block) FILTER (WHERE body) AS first, max(block) FILTER (WHERE body) AS last,
  coalesce(arg_max(coalesce(right(rtrim(text), 1) IN ('.', '!', '?'), false), block) FILTER (WHERE body), false) AS ended FROM b GROUP BY doc, page),
s AS (SELECT doc, i, page, first, last, false AS moved, n > 0 AND NOT ended AS open, page AS page_into, last AS block_into FROM p WHERE i = 1
  UNION ALL SELECT p.doc, p.i, p.page, p.first, p.last, s.open AND p.n > 0, p.n - CASE WHEN s.open AND p.n > 0 THEN 1 ELSE 0 END > 0 AND NOT p.ended, s.page, s.last FROM s JOIN p ON p.doc = s.doc AND p.i = s.i + 1),
t AS (SELECT s.doc, s.page_into, s.block_into, b.text AS more, b.line_count AS more_lines FROM s JOIN b ON s.moved AND b.doc = s.doc AND b.page = s.page AND b.block = s.first)
SELECT b.doc, b.page, b.block, CASE WHEN more IS NULL THEN b.text ELSE concat(rtrim(b.text), ' ', ltrim(more)) END AS text, CAST(b.line_count + coalesce(more_lines, 0) AS INT) AS line_count
FROM b LEFT JOIN t ON t.doc = b.doc AND t.page_into = b.page AND t.block_into = b.block WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.moved AND s.doc = b.doc AND s.page = b.page AND s.first = b.block)""")
def repair_cross_page(v):
    return K.repair_cross_page(v.blocks).select("doc", "page", "block", "text", "line_count")


@query(f"""WITH h AS (SELECT *, {HEAD} AS header, coalesce(sum(CASE WHEN {HEAD} THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp,
  max(page) OVER (PARTITION BY doc) AS last_page FROM blocks),
g AS (SELECT doc, grp, string_agg(text, chr(10) ORDER BY page, block) AS text, max(page) FILTER (WHERE NOT header) AS page, max(block) FILTER (WHERE NOT header) AS block_id, count(*) FILTER (WHERE NOT header) AS n FROM h GROUP BY doc, grp)
SELECT doc, page, block_id, text, false AS is_header FROM g WHERE n = 1
UNION ALL SELECT h.doc, h.last_page, h.block, h.text, true FROM h JOIN g ON h.doc = g.doc AND h.grp = g.grp WHERE g.n = 0""")
def attach_headers(v):
    return K.attach_headers(v.blocks.withColumnRenamed("block", "block_id")).select("doc", "page", "block_id", "text", "is_header")


# The last place (from 0) of a mark in a text, and the first one; -1 without any.
def _last(t: str, mark: str) -> str:
    turned = f"concat({', '.join(f'chr({ord(x)})' for x in reversed(mark))}, '')"
    return f"(CASE WHEN strpos(reverse({t}), {turned}) > 0 THEN length({t}) - strpos(reverse({t}), {turned}) + 1 - {len(mark)} ELSE -1 END)"


def _first(t: str, mark: str) -> str:
    return f"(strpos({t}, '{mark}') - 1)"


_W = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ends = ", ".join(f"CASE WHEN {_first('tail', m + ' ')} >= 0 THEN {_first('tail', m + ' ')} END" for m in ".!?")


def _cuts(src: str) -> str:
    """Chunks of texts by split_text: recursive members from src (id, body)."""
    return f"""cuts AS (SELECT id, body, -1 AS n, '' AS chunk, 0 AS start, false AS done FROM {src} WHERE body <> ''
  UNION ALL SELECT id, body, n + 1, CASE WHEN final THEN trim(substr(body, start + 1), {_W}) ELSE rtrim(substr(w, 1, cut), {_W}) END,
    CASE WHEN final OR length(body) - start - cut <= 1500 THEN start + cut WHEN ends IS NOT NULL THEN low + ends + 2 WHEN word >= 0 THEN low + word + 1 ELSE start + cut END, final
  FROM (SELECT *, least({_ends}) AS ends, {_first('tail', ' ')} AS word FROM (SELECT *, greatest(start + cut - 150, start + 1) AS low, substr(body, greatest(start + cut - 150, start + 1) + 1, start + cut - greatest(start + cut - 150, start + 1)) AS tail FROM (
    SELECT *, CASE WHEN {_last('w', chr(10) * 2)} >= 1350 THEN {_last('w', chr(10) * 2)} WHEN {_last('w', chr(10))} >= 1350 THEN {_last('w', chr(10))} WHEN {_last('w', ' ')} >= 1350 THEN {_last('w', ' ')} ELSE 1500 END AS cut
    FROM (SELECT id, body, n, start, length(body) - start <= 1500 AS final, substr(body, start + 1, 1500) AS w FROM cuts WHERE NOT done)))))"""


@query(f"""WITH RECURSIVE src AS (SELECT doc_id AS id, trim(coalesce(text, ''), {_W}) AS body FROM documents), {_cuts('src')}
SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS idx, chunk FROM cuts WHERE n >= 0 AND chunk <> ''""")
def split_text(v):
    return v.table("documents").select("doc_id", F.posexplode(K.split_text(F.col("text"))).alias("idx", "chunk"))


def _windows(src: str) -> str:
    """Windows of long paragraphs: recursive members from src (doc_id, i, body)."""
    return f"""wins AS (SELECT doc_id, i, body, -1 AS n, '' AS chunk, 0 AS start FROM {src}
  UNION ALL SELECT doc_id, i, body, n + 1, trim(substr(body, start + 1, stop - start), {_W}), CASE WHEN stop - 150 > start THEN stop - 150 ELSE stop END
  FROM (SELECT *, start + CASE WHEN start + 800 >= length(body) THEN 800 WHEN {_last('w', '. ')} > 0 THEN {_last('w', '. ')} + 1 WHEN {_last('w', chr(10))} > 0 THEN {_last('w', chr(10))} + 1 WHEN {_last('w', ' ')} > 0 THEN {_last('w', ' ')} + 1 ELSE 800 END AS stop
    FROM (SELECT doc_id, i, body, n, start, substr(body, start + 1, 800) AS w FROM wins WHERE start < length(body))))"""


@query(f"""WITH RECURSIVE src AS (SELECT doc_id, 0 AS i, coalesce(text, '') AS body FROM documents), {_windows('src')}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS idx, chunk FROM wins WHERE n >= 0 AND chunk <> ''""")
def split_long(v):
    return v.table("documents").select("doc_id", F.posexplode(K.split_long(F.col("text"))).alias("idx", "chunk"))


@query(f"""WITH RECURSIVE whole AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents),
parts AS (SELECT doc_id, list_filter(string_split(t, chr(10) || chr(10)), lambda p: trim(p, {_W}) <> '') AS ps FROM whole WHERE length(t) > 800),
src AS (SELECT doc_id, i, body FROM (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS body FROM parts) WHERE length(body) > 798), {_windows('src')},
longs AS (SELECT doc_id, i, list(chunk ORDER BY n) FILTER (WHERE n >= 0 AND chunk <> '') AS chunks FROM wins GROUP BY doc_id, i),
fold AS (SELECT doc_id, ps, 0 AS i, '' AS now, CAST([] AS VARCHAR[]) AS out FROM parts
  UNION ALL SELECT f.doc_id, f.ps, f.i + 1, CASE WHEN length(now) + length(p) + 2 <= 800 THEN trim(now || chr(10) || chr(10) || p, {_W}) WHEN now <> '' THEN ltrim(right(now, 150), {_W}) || chr(10) || chr(10) || p ELSE '' END,
    CASE WHEN length(now) + length(p) + 2 <= 800 THEN out WHEN now <> '' THEN list_append(out, trim(now, {_W})) ELSE list_concat(out, coalesce(l.chunks, CAST([] AS VARCHAR[]))) END
  FROM (SELECT *, list_extract(ps, i + 1) AS p FROM fold WHERE i < len(ps)) f LEFT JOIN longs l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
every AS (SELECT doc_id, list_filter(list_append(out, trim(now, {_W})), lambda c: length(c) > 20) AS chunks FROM fold WHERE i = len(ps)
  UNION ALL SELECT doc_id, list_filter([trim(t, {_W})], lambda c: c <> '') FROM whole WHERE length(t) <= 800)
SELECT doc_id, CAST(unnest(range(len(chunks))) AS INT) AS idx, unnest(chunks) AS chunk FROM every""")
def chunk_paragraphs(v):
    return v.table("documents").select("doc_id", F.posexplode(K.chunk_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("idx", "chunk"))


# repair over page ends, blocks joined up to 300 signs, headers put before what follows them, texts cut
@query(f"""WITH RECURSIVE b AS (SELECT *, type = 'text' AND NOT {HEAD} AS body FROM blocks),
p AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS i, count(*) FILTER (WHERE body) AS n, min(block) FILTER (WHERE body) AS first, max(block) FILTER (WHERE body) AS last,
  coalesce(arg_max(coalesce(right(rtrim(text), 1) IN ('.', '!', '?'), false), block) FILTER (WHERE body), false) AS ended FROM b GROUP BY doc, page),
s AS (SELECT doc, i, page, first, last, false AS moved, n > 0 AND NOT ended AS open, page AS page_into, last AS block_into FROM p WHERE i = 1
  UNION ALL SELECT p.doc, p.i, p.page, p.first, p.last, s.open AND p.n > 0, p.n - CASE WHEN s.open AND p.n > 0 THEN 1 ELSE 0 END > 0 AND NOT p.ended, s.page, s.last FROM s JOIN p ON p.doc = s.doc AND p.i = s.i + 1),
t AS (SELECT s.doc, s.page_into, s.block_into, b.text AS more, b.line_count AS more_lines FROM s JOIN b ON s.moved AND b.doc = s.doc AND b.page = s.page AND b.block = s.first),
repaired AS (SELECT b.doc, b.page, row_number() OVER (PARTITION BY b.doc, b.page ORDER BY b.block) - 1 AS i, b.type, b.ratio_to_body, CASE WHEN more IS NULL THEN b.text ELSE concat(rtrim(b.text), ' ', ltrim(more)) END AS text, b.line_count + coalesce(more_lines, 0) AS line_count
  FROM b LEFT JOIN t ON t.doc = b.doc AND t.page_into = b.page AND t.block_into = b.block WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.moved AND s.doc = b.doc AND s.page = b.page AND s.first = b.block)),
src AS (SELECT *, {HEAD} OR type <> 'text' AS alone FROM repaired),
m AS (SELECT doc, page, i, 0 AS block_id, text, type, ratio_to_body, CASE WHEN alone OR length(text) >= 300 THEN 1 ELSE 0 END AS shut, length(text) AS size, line_count FROM src WHERE i = 0
  UNION ALL SELECT n.doc, n.page, n.i, CASE WHEN shut = 1 OR n.alone THEN block_id + 1 ELSE block_id END, CASE WHEN shut = 1 OR n.alone THEN n.text ELSE concat(m.text, chr(10), n.text) END, CASE WHEN shut = 1 OR n.alone THEN n.type ELSE m.type END,
    CASE WHEN shut = 1 OR n.alone THEN n.ratio_to_body ELSE m.ratio_to_body END, CASE WHEN n.alone OR (CASE WHEN shut = 1 THEN 0 ELSE m.size END) + length(n.text) >= 300 THEN 1 ELSE 0 END,
    CASE WHEN shut = 1 OR n.alone THEN length(n.text) ELSE m.size + length(n.text) END, CASE WHEN shut = 1 OR n.alone THEN n.line_count ELSE m.line_count + n.line_count END
  FROM m JOIN src n ON m.doc = n.doc AND m.page = n.page AND n.i = m.i + 1),
joined AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc, page, block_id ORDER BY i DESC) = 1),
h AS (SELECT *, {HEAD} AS header, coalesce(sum(CASE WHEN {HEAD} THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp, max(page) OVER (PARTITION BY doc) AS last_page FROM joined),
g AS (SELECT doc, grp, string_agg(text, chr(10) ORDER BY page, block_id) AS text, max(page) FILTER (WHERE NOT header) AS page, max(block_id) FILTER (WHERE NOT header) AS block_id, max(type) FILTER (WHERE NOT header) AS type,
  coalesce(string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY page, block_id) FILTER (WHERE header), '') AS heads, count(*) FILTER (WHERE NOT header) AS n FROM h GROUP BY doc, grp),
parts AS (SELECT *, row_number() OVER (ORDER BY doc, page, block_id, is_header, text) AS id FROM (SELECT doc, page, block_id, type, text, false AS is_header, heads FROM g WHERE n = 1
  UNION ALL SELECT h.doc, h.last_page, h.block_id, 'header', h.text, true, '' FROM h JOIN g ON h.doc = g.doc AND h.grp = g.grp WHERE g.n = 0)),
bodies AS (SELECT id, trim(text, {_W}) AS body FROM parts WHERE type <> 'table' AND NOT is_header), {_cuts('bodies')},
chunks_ AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS chunk_idx, chunk FROM cuts WHERE n >= 0 AND chunk <> '' UNION ALL SELECT id, 0, text FROM parts WHERE type = 'table' OR is_header),
named AS (SELECT doc, page, block_id, chunk_idx, chunk AS text, is_header, type AS block_type, CASE WHEN chunk_idx = 0 THEN heads END AS header_ids, row_number() OVER (PARTITION BY doc, page, block_id, chunk_idx ORDER BY is_header, chunk) - 1 AS again FROM chunks_ JOIN parts ON chunks_.id = parts.id)
SELECT doc, page, block_id, chunk_idx, concat_ws('_', doc, page, block_id, chunk_idx) || CASE WHEN again > 0 THEN '_h' || again ELSE '' END AS chunk_id, text, is_header, block_type, header_ids FROM named""")
def chunk_documents(v):
    return K.chunk_documents(v.blocks).withColumn("header_ids", F.array_join("header_block_ids", ",")).drop("header_block_ids")
