"""The queries of this folder's operators, over the whole of their tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.clustering import cluster_vectors
from quire.llm.common import new_path, table
from quire.llm.decontamination import benchmark_hits
from quire.llm.fill_in_middle import fill_in_middle, restored
from quire.llm.language_id import language_id
from quire.llm.line_dedup import line_dedup
from quire.llm.lm_scoring import lm_scores
from quire.llm.media import features, payloads, store
from quire.llm.mixing import mix_to_targets
from quire.llm.near_duplicates import near_duplicates
from quire.llm.packing import best_fit_packing
from quire.llm.pii import replace_pii
from quire.llm.quality import quality_rules
from quire.llm.token_counts import fill_cache, token_counts


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, ngram=5).drop("stays")


#: Marginals to rake to: half of English, the other languages in proportion; the shares of sources, and of the learned topics of
#: each language, evened out by powers.
MIX = {"source": 0.5, "lang": {"en": 0.5, "*": 0.5}, "topic": ("lang", 0.8)}


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"), MIX, fraction=0.5)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls on one cache: the contents whose digests begin with 0 or 1 fill it, then all documents take their counts from
    it, which encodes the other contents alone."""
    docs, cache, tokenizer = table(spark, sf_dir, "documents"), new_path(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model")
    fill_cache(docs.where(F.sha2(F.coalesce("text", F.lit("")), 256) < "2"), tokenizer, cache)
    return token_counts(docs, tokenizer, cache)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1)


def in_fold(modulus: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is fold; a null id is in fold 0, as the empty text is."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == fold


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), in_fold(4, 2))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), in_fold(5, 1))


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(payloads(table(spark, sf_dir, "documents"))))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), key="a key that the caller keeps")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50)
    return rows.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


# The parts of three operators' results that SQL can express, as queries of their own.
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality_rules(spark, sf_dir).drop("kept", "llr")


def mix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mix_sources(spark, sf_dir).select("doc_id", "source", "lang", "n_tokens")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict:
    dealt = (op1_line_dedup, op2_ngram_jaccard_join, op3_mix_sources, op4_quality_rules, op5_token_counts, op6_best_fit_packing, op7_language_id, op8_lm_scoring, op9_media_tiff, op10_pii_surrogates, op11_fill_in_middle, op12_centroid_clustering, op13_decontamination)
    return {f.__name__: f for f in (*dealt, quality_counts, mix_tokens, lm_base_scores)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "quality_counts": QUALITY_SQL, "mix_tokens": MIX_SQL, "lm_base_scores": LM_SQL, "op11_fill_in_middle": FIM_SQL, "op12_centroid_clustering": CLUSTER_SQL, "op13_decontamination": LEAK_SQL}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""

QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dups AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(inside.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN dups ON w.doc_id = dups.doc_id LEFT JOIN inside ON w.doc_id = inside.doc_id
"""
MIX_SQL = r"""
SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
"""
LM_SQL = r"""
WITH f AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 5 = 1 AS held_out FROM documents),
w AS (SELECT doc_id, held_out, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word FROM f),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
ends AS (SELECT count(*) AS c FROM f WHERE NOT held_out),
n AS (SELECT coalesce(sum(c.c), 0) + any_value(ends.c) AS n, count(c.word) + any_value((ends.c > 0)::INT) AS v, any_value(ends.c) AS ends FROM ends LEFT JOIN c ON true),
s AS (SELECT doc_id, count(*) AS words, count(c.word) AS known, sum(log10(coalesce(c.c, 0) + 0.5)) AS logs FROM w LEFT JOIN c ON w.word = c.word GROUP BY doc_id)
SELECT f.doc_id, f.held_out, coalesce(words, 0) + 1 AS n_tokens, coalesce(known, 0) + (ends > 0)::INT AS n_known, n::BIGINT AS train_tokens,
  round(coalesce(logs, 0) + log10(ends + 0.5) - (coalesce(words, 0) + 1) * log10(n + 0.5 * (v + 1)), 4) AS base_score
FROM f CROSS JOIN n LEFT JOIN s ON f.doc_id = s.doc_id
"""
FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
n AS (SELECT *, len(l)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i::INT, 8))::BIGINT) AS hs FROM d),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def cluster_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """Assignments a0, a1, ... to centroids c0, c1, ..., one after the other."""
    steps = []
    for r in range(rounds + 1):
        square = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.row, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min(struct_pack(d := {square}, c := c.c)) AS m FROM kept x CROSS JOIN c{r} c GROUP BY x.row)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT m.c AS c, unnest(range({dims})) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c) w ON o.c = w.c)")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {k}),
{", ".join(steps)}
SELECT vec_id, m.c::INT AS cluster, m.d::BIGINT AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.m.c = c.c
"""


CLUSTER_SQL = cluster_sql()
#: Windows are looked up as they are, all of a document's against all of the items'; n_near by the two rarest terms of each window.
LEAK_SQL = r"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS MATERIALIZED (SELECT *, least(len(ws), 10) AS k FROM (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
bp AS (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM bw),
windows AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(ws[j:j + k - 1], ' ') AS w FROM bp),
pos AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM dw, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k),
found AS MATERIALIZED (SELECT doc_id, j, a.k, item FROM pos a JOIN windows w ON a.k = w.k AND array_to_string(a.ws[a.j:a.j + a.k - 1], ' ') = w.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
tokens AS MATERIALIZED (SELECT doc_id, unnest(range(len(ws))) AS p, lower(unnest(ws)) AS t FROM dw),
freq AS (SELECT t, count(*) AS f FROM tokens GROUP BY t),
terms AS (SELECT item, k, n, list(struct_pack(f := coalesce(f, 0), o := o, t := bt.t) ORDER BY o) AS ts FROM (SELECT item, k, len(ws) AS n, unnest(range(len(ws))) AS o, lower(unnest(ws)) AS t FROM bw) bt LEFT JOIN freq ON bt.t = freq.t GROUP BY item, k, n),
rare AS (SELECT DISTINCT item, r[1] AS x, CASE WHEN len(r) > 1 THEN r[2] ELSE r[1] END AS y FROM (SELECT item, list_sort(ts[j:j + k - 1])[1:2] AS r FROM (SELECT *, unnest(range(1, n - k + 2)) AS j FROM terms)) WHERE r[1].f > 0),
near AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT a.doc_id, item FROM rare r JOIN tokens a ON a.t = r.x.t JOIN tokens b ON b.t = r.y.t AND a.doc_id = b.doc_id AND abs((a.p - r.x.o) - (b.p - r.y.o)) <= 3) AS m ANTI JOIN found f ON m.doc_id = f.doc_id AND m.item = f.item GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0)::BIGINT AS n_near
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN named ON dw.doc_id = named.doc_id LEFT JOIN near ON dw.doc_id = near.doc_id
"""
