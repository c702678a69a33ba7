"""Queries of retrieval, prompts, evaluation, geo, report, audits, maintenance and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geo as G
from quire.functions import text as T
from quire.functions import vector as V
from quire.operators import audit as A
from quire.operators import chunking as K
from quire.operators import report as P
from quire.operators import retrieval as R
from quire.operators import store as ST
from quire.operators import tables as D
from quire.operators import text_index as TI
from quire.operators import vector_search as X
from quire.plans.fixtures import query
from quire.sources import files as S
from quire.sources.staging import file_system, new_path
from quire.streaming import jobs as J

#: Keywords of each sensor type, here in the invented languages of the test documents.
KEYWORDS = {"SMOKE": ["the ", "fire"], "TEMPERATURE": ["hitze", "chzu "], "MOTION": ["zzz"], "CAMERA": ["eaux"], "FLOOD": [], "GAS": ["ción"], "ACCESS_CONTROL": ["xyzzy", "qqq"], "OTHER": ["ing "]}
DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
COS = f"{DOT} / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


def stated(v):
    """The queries: every vector whose id is divisible by 20, against all."""
    return v.vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def found(v, k=5, **more):
    return R.knn_exact(stated(v), v.vectors, k, vector_id="chunk_id", **more)


HITS = f"""hits AS (SELECT query_id, chunk_id, CAST(n AS INT) AS rank, s AS similarity FROM (SELECT a.chunk_id AS query_id, b.chunk_id, {COS} AS s,
  row_number() OVER (PARTITION BY a.chunk_id ORDER BY {COS} DESC, b.chunk_id) AS n FROM vectors a JOIN vectors b ON a.chunk_id % 20 = 0) WHERE n <= 5)"""


@query(f"WITH {HITS} SELECT query_id, chunk_id, rank, round(similarity, 5) AS similarity FROM hits")
def knn_exact(v):
    return found(v).withColumn("similarity", F.round("similarity", 5))


@query(f"""SELECT query_id, chunk_id, CAST(n AS INT) AS rank FROM (SELECT a.chunk_id AS query_id, b.chunk_id, row_number() OVER (PARTITION BY a.chunk_id ORDER BY {COS} DESC, b.chunk_id) AS n
  FROM vectors a JOIN vectors b ON a.chunk_id % 20 = 0 AND b.document_id = 3) WHERE n <= 5""")
def knn_filtered(v):
    return found(v, where=F.col("document_id") == 3).drop("similarity")


@query()
def knn_approx(v):
    return near(v)


def near(v):
    """An index is built, and then searched."""
    index = X.build_vector_index(v.vectors, place(v, "vector-index"), vector_id="chunk_id")
    return X.search_vectors(stated(v), index, 5).withColumnRenamed("vec_id", "chunk_id")


@query(f"WITH {HITS} SELECT count(*) AS neighbours, true AS enough FROM hits")
def knn_approx_recall(v):
    """How many neighbours the exact search has, and whether the approximate one finds nine tenths of them or more."""
    both = found(v).join(near(v).select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(f"SELECT a.chunk_id, round({COS}, 6) AS similarity FROM vectors a JOIN vectors b ON b.chunk_id = a.chunk_id - a.chunk_id % 20")
def cosine(v):
    b = v.vectors.select(F.col("chunk_id").alias("of"), F.col("embedding").alias("other"))
    rows = v.vectors.join(b, F.col("of") == F.col("chunk_id") - F.col("chunk_id") % 20)
    return rows.select("chunk_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("""SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 0 ELSE round(x[1], 6) END AS first, CASE WHEN chunk_id % 3 = 0 THEN 0 ELSE round(x[64], 6) END AS last FROM (
  SELECT chunk_id, list_transform(e, lambda y: y / sqrt(list_inner_product(e, e))) AS x FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors))""")
def l2_normalize(v):
    """Of vectors three times as long, and of zero vectors for every third one."""
    unit = V.l2_normalize(F.transform("embedding", lambda x: F.when(F.col("chunk_id") % 3 == 0, 0.0).otherwise(x * 3)))
    return v.vectors.select("chunk_id", F.round(F.get(unit, F.lit(0)), 6).alias("first"), F.round(F.get(unit, F.lit(63)), 6).alias("last"))


@query("SELECT chunk_id, unnest(range(64)) AS place, round(unnest(CAST(embedding AS DOUBLE[])), 3) + 0.0::DOUBLE AS x FROM vectors")
def parse_embedding(v):
    return v.vectors.select("chunk_id", F.posexplode(V.parse_embedding(F.to_json("embedding"))).alias("place", "x")).select("chunk_id", F.col("place").cast("long").alias("place"), (F.round("x", 3) + 0.0).alias("x"))


def placed(v):
    files = v.files.select("file_id", F.col("filename"), F.col("workspace_id"))
    chunks = v.vectors.withColumnRenamed("document_id", "file_id").withColumn("content", F.col("text"))
    return chunks, files


@query("""SELECT chunk_id, round(s, 4) AS score FROM (SELECT v.chunk_id, list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(range(64) AS DOUBLE[])) / (sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(range(64) AS DOUBLE[]), CAST(range(64) AS DOUBLE[])))) AS s
  FROM vectors v JOIN files f ON v.document_id = f.file_id WHERE f.workspace_id = 'src1' ORDER BY s DESC, v.chunk_id LIMIT 5) WHERE s > 0.1""")
def semantic_search(v):
    chunks, files = placed(v)
    return R.semantic_search(chunks, files, "src1", [float(x) for x in range(64)]).select("chunk_id", "score")


@query("SELECT c.file_id, c.chunk_index, CAST(1.0 AS DOUBLE) AS score FROM chunks c JOIN files f ON c.file_id = f.file_id WHERE f.workspace_id = 'src2' AND contains(lower(content), 'the') ORDER BY c.file_id, c.chunk_index LIMIT 5")
def keyword_search(v):
    return R.keyword_search(v.chunks.drop("workspace_id"), v.files, "src2", "THE").select("file_id", "chunk_index", "score")


@query(f"WITH {HITS} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS INT) AS rank, CAST(chunk_id AS DOUBLE) AS score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) <= 3")
def rerank(v):
    return R.rerank(found(v).withColumnRenamed("similarity", "score"), 3, F.col("chunk_id")).select("query_id", "chunk_id", "rank", "score")


def vowels(texts):
    """A model of five numbers that SQL can count too."""
    return [[t.count(c) for c in "aeiou"] for t in texts]


_vowels = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "aeiou")


@query(f"""SELECT item_id, unnest(range(5)) AS place, round(unnest(CASE WHEN list_inner_product(x, x) > 0 THEN list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) ELSE x END), 9) AS x
  FROM (SELECT item_id, CAST([{_vowels}] AS DOUBLE[]) AS x FROM (SELECT item_id, 'query: ' || text AS t FROM benchmark))""")
def embed_batches(v):
    rows = R.embed_batches(v.table("benchmark"), "text", vowels, prefix="query: ")
    return rows.select("item_id", F.posexplode("embedding").alias("place", "x")).select("item_id", F.col("place").cast("long").alias("place"), F.round("x", 9).alias("x"))


def fails_for_some(texts):
    """The same model, which refuses a batch that holds a certain text."""
    if any(t.endswith(("a.", "s.")) for t in texts):
        raise ValueError("unreadable")
    return vowels(texts)


@query("""SELECT how, count(*) AS n, count(DISTINCT text) AS contents FROM (SELECT text, CASE WHEN text LIKE '%a.' OR text LIKE '%s.' THEN 'failed' WHEN text IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 3 = 0) THEN 'reused' ELSE 'new' END AS how
  FROM (SELECT coalesce(text, '') AS text FROM documents)) GROUP BY how""")
def embed_cached(v):
    """A third of the documents fill the cache, then all take their vectors from it; the model fails for some."""
    docs, cache = v.table("documents").withColumn("text", F.coalesce("text", F.lit(""))), place(v, "embeddings")
    R.embed_cached(docs.where("doc_id % 3 = 0"), "text", cache, 5, fails_for_some)
    return R.embed_cached(docs, "text", cache, 5, fails_for_some).groupBy("how").agg(F.count("*").alias("n"), F.countDistinct("text").alias("contents"))


def lines_of(v):
    return v.chunks.select(F.concat_ws("_", "file_id", "chunk_index").alias("chunk_id"), F.col("file_id").alias("document_id"), F.lit(1).alias("page"), F.col("content").alias("text"))


def passages_asked(v):
    return v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def searched(v):
    """Every benchmark passage against every line of the documents, by hashed words and then by BM25 over all lines."""
    queries = R.embed_batches(passages_asked(v), "query", prefix="")
    lines = lines_of(v)
    vectors = R.embed_batches(lines.select("chunk_id", "text"), "text", prefix="")  # once, on their way to the queries; never stored
    return R.two_stage_search(queries, vectors, 5, index=TI.add_to_index(lines, place(v, "text-index")), texts=lines)


LINES = "lines AS MATERIALIZED (SELECT CAST(file_id AS VARCHAR) || '_' || CAST(chunk_index AS VARCHAR) AS chunk_id, file_id AS document_id, content FROM chunks)"
BM25 = f"""{LINES}, tokens AS MATERIALIZED (SELECT chunk_id, w, count(*) AS tf FROM (SELECT chunk_id, unnest(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM lines) WHERE w <> '' GROUP BY chunk_id, w),
  sizes AS (SELECT l.chunk_id, coalesce(sum(tf), 0) AS length FROM lines l LEFT JOIN tokens t ON l.chunk_id = t.chunk_id GROUP BY l.chunk_id), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM sizes),
  asked AS (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark), idf AS (SELECT w, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tokens, stats WHERE w IN (SELECT w FROM asked) GROUP BY w),
  scored AS MATERIALIZED (SELECT query_id, t.chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM asked a JOIN idf ON a.w = idf.w JOIN tokens t ON a.w = t.w JOIN sizes z ON t.chunk_id = z.chunk_id, stats GROUP BY query_id, t.chunk_id)"""
_crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: ('0x' || hex(encode(w))[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x:
  list_reduce([0, 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(c, x))), 4294967295::BIGINT)"""
# list_reduce() begins with the first element of its list: the state before the first byte, and the state itself in the inner one.
_crc = _crc.replace("list_reduce([0, 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda a, k:", "list_reduce(list_prepend(xor(c, x), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda a, k:").replace(" END, xor(c, x)))", " END))")
STAGES = f"""{BM25}, said AS MATERIALIZED (SELECT 'l' || chunk_id AS id, unnest(regexp_extract_all(lower(content), '\\S+')) AS w FROM lines UNION ALL SELECT 'q' || CAST(item_id AS VARCHAR), unnest(regexp_extract_all(lower(text), '\\S+')) FROM benchmark),
  crcs AS MATERIALIZED (SELECT w, {_crc} AS h FROM (SELECT DISTINCT w FROM said)), sums AS MATERIALIZED (SELECT id, h % 64 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM said JOIN crcs USING (w) GROUP BY id, h % 64),
  norms AS MATERIALIZED (SELECT id, sqrt(sum(x * x)) AS norm FROM sums GROUP BY id HAVING sum(x * x) > 0), cosines AS (SELECT a.id AS q, b.id AS l, sum(a.x * b.x) AS dot FROM sums a JOIN sums b ON a.place = b.place WHERE a.id LIKE 'q%' AND b.id LIKE 'l%' GROUP BY a.id, b.id),
  near AS (SELECT CAST(substr(q, 2) AS BIGINT) AS query_id, substr(l, 2) AS chunk_id, round(dot / (a.norm * b.norm), 10) AS similarity FROM cosines JOIN norms a ON q = a.id JOIN norms b ON l = b.id),
  twenty AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS first FROM near QUALIFY first <= 20),
  five AS (SELECT t.query_id, t.chunk_id, document_id, coalesce(s.score, similarity) AS score, CAST(row_number() OVER (PARTITION BY t.query_id ORDER BY coalesce(s.score, -first) DESC, t.chunk_id) AS INT) AS rank FROM twenty t JOIN lines USING (chunk_id) LEFT JOIN scored s ON t.query_id = s.query_id AND t.chunk_id = s.chunk_id QUALIFY rank <= 5)"""


@query(f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored QUALIFY rank <= 10")
def bm25_search(v):
    """Every benchmark passage against all lines that share a word with it."""
    index = TI.add_to_index(lines_of(v), place(v, "text-index"))
    return TI.bm25_search(passages_asked(v), index, 10).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25}, listed AS (SELECT item_id AS query_id, chunk_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY chunk_id) AS INT) AS place FROM benchmark, lines WHERE CAST(document_id AS BIGINT) % 40 = item_id % 40)"
    " SELECT l.query_id, l.chunk_id, round(coalesce(score, -place), 6) AS score, CAST(row_number() OVER (PARTITION BY l.query_id ORDER BY coalesce(score, -place) DESC, l.chunk_id) AS INT) AS rank FROM listed l LEFT JOIN scored s ON l.query_id = s.query_id AND l.chunk_id = s.chunk_id QUALIFY rank <= 3")
def rerank_bm25(v):
    """Of the lines of some documents for each passage, in the order of their ids, the three best by BM25 over all lines."""
    lines = lines_of(v)
    index = TI.add_to_index(lines, place(v, "text-index"))
    listed = passages_asked(v).join(lines, F.col("document_id") % 40 == F.col("query_id") % 40).select("query_id", "chunk_id")
    listed = R.rank_hits(listed, "query_id", "chunk_id", 1 << 30, "chunk_id", descending=False).withColumn("score", -F.col("rank").cast("double"))
    return R.rerank_bm25(listed, passages_asked(v), index, 3).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {STAGES} SELECT query_id, chunk_id, document_id, round(score, 6) AS score, rank FROM five")
def two_stage_search(v):
    return searched(v).select("query_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {HITS} SELECT query_id, document_id, 1 AS page, min(rank) AS first, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank), document_id) AS INT) AS place FROM hits h JOIN vectors x ON h.chunk_id = x.chunk_id GROUP BY query_id, document_id")
def cited_sources(v):
    return R.cited_sources(found(v).join(v.vectors.select("chunk_id", "document_id"), "chunk_id").withColumn("page", F.lit(1)))


BLOCK = f"""WITH {HITS}, ctx AS (SELECT query_id, CAST(count(*) AS INT) AS n_passages, string_agg('[' || CAST(rank AS VARCHAR) || '] Document: ' || CAST(document_id AS VARCHAR) || ', page 1' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits h JOIN vectors x ON h.chunk_id = x.chunk_id GROUP BY query_id)"""


def passages(v):
    return found(v).join(v.vectors.drop("embedding"), "chunk_id").withColumn("page", F.lit(1))


@query(f"{BLOCK} SELECT * FROM ctx")
def context_block(v):
    return R.context_block(passages(v))


@query(f"""{BLOCK} SELECT b.item_id AS query_id, 'Question: ' || b.text || chr(10) || chr(10) || 'Passages: ' || CAST(coalesce(n_passages, 0) AS VARCHAR) || chr(10) || chr(10) || coalesce(context, '(no passages found)') || chr(10) || chr(10) || 'Answer from the passages alone and cite them.' AS prompt
  FROM benchmark b LEFT JOIN ctx ON b.item_id = ctx.query_id""")
def build_prompts(v):
    return R.build_prompts(v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), passages(v))


@query("SELECT query_id, coalesce(top_k, 5) AS top_k, coalesce(trim(query) <> '' AND coalesce(top_k, 5) BETWEEN 1 AND 50, false) AS accepted FROM questions")
def validate_queries(v):
    ok, bad = R.validate_queries(v.questions)
    return ok.select("query_id", "top_k", F.lit(True).alias("accepted")).union(bad.select("query_id", "top_k", F.lit(False)))


@query("SELECT query_id, CASE WHEN contains(answer, ' Sources: ') THEN regexp_replace(answer, ' Sources: [0-9]+$', '') ELSE answer END AS body, regexp_extract(answer, '[0-9]+$') AS footer FROM answers")
def split_answer_footer(v):
    body, footer = T.split_answer_footer(F.col("answer"), " Sources: ")
    return v.answers.select("query_id", body.alias("body"), footer.alias("footer"))


def golden(v):
    return v.table("benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 2 == 0, "number").otherwise("name").alias("metric_focus"), F.array((F.col("item_id") % 7).cast("int")).alias("expected_pages"))


def page_hits(v):
    return found(v).select(F.col("query_id").alias("question_id"), "rank", (F.col("chunk_id") % 50).cast("int").alias("page"))


JUDGED = f"WITH {HITS}, judged AS (SELECT b.item_id AS question_id, CASE WHEN b.item_id % 2 = 0 THEN 'number' ELSE 'name' END AS metric_focus, coalesce(bool_or(h.chunk_id % 50 = b.item_id % 7 + 31), false) AS success FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id GROUP BY b.item_id)"


@query(f"{JUDGED} SELECT * FROM judged")
def retrieval_hits(v):
    return R.retrieval_hits(golden(v), page_hits(v)).select("question_id", "metric_focus", "success")


@query(f"{JUDGED} SELECT metric_focus, count(*) AS questions, count(*) FILTER (WHERE success) AS hits, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) * 100, 4) AS recall FROM judged GROUP BY metric_focus")
def recall_at_k(v):
    return R.recall_at_k(R.retrieval_hits(golden(v), page_hits(v)), "metric_focus")


@query(f"""WITH {HITS} SELECT b.item_id AS question_id, CASE WHEN b.item_id % 4 = 3 THEN 'out_of_context' ELSE 'in_context' END AS query_type,
  CASE WHEN b.item_id % 4 <> 3 THEN coalesce(bool_or(x.document_id = b.item_id % 10), false) END AS recall_hit FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id LEFT JOIN vectors x ON x.chunk_id = h.chunk_id GROUP BY b.item_id""")
def eval_rows(v):
    asked = v.table("benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 4 == 3, "out_of_context").otherwise("in_context").alias("query_type"), (F.col("item_id") % 10).alias("expected_doc"), F.lit(None).cast("int").alias("expected_page"))
    return R.eval_rows(asked, passages(v).withColumnRenamed("query_id", "question_id"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def documents_with(v):
    return R.documents_with(v.table("documents"), v.table("benchmark"))


WORDS_ASKED = "keywords AS (SELECT DISTINCT keyword FROM (SELECT unnest(string_split_regex(text, '[^\\p{L}]+')) AS keyword FROM benchmark) WHERE length(keyword) > 3)"


@query(f"WITH {WORDS_ASKED}, {LINES} SELECT keyword, count(*) AS n, min(chunk_id) AS first FROM keywords JOIN lines ON contains(lower(content), lower(keyword)) GROUP BY keyword")
def keyword_hits(v):
    """Every word of the benchmark, of four letters or more, in all lines, inside longer words too."""
    words = v.table("benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("keyword")).where(F.length("keyword") > 3).distinct()
    return R.keyword_hits(lines_of(v), words, content="text").groupBy("keyword").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))


@query(f"""WITH {STAGES}, holding AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), met AS (SELECT DISTINCT item_id FROM holding JOIN five ON item_id = query_id AND doc_id = document_id)
  SELECT count(DISTINCT h.item_id) AS questions, count(DISTINCT m.item_id) AS hits FROM holding h LEFT JOIN met m ON h.item_id = m.item_id""")
def recall_of_passages(v):
    """Flagship: the share of benchmark passages whose document is among the first five lines found."""
    hits = searched(v).withColumnRenamed("query_id", "question_id")
    asked = R.documents_with(v.table("documents"), v.table("benchmark")).select(F.col("item_id").alias("question_id"), F.col("doc_id").alias("expected_doc"))
    met = asked.join(hits.select("question_id", F.col("document_id").alias("expected_doc")), ["question_id", "expected_doc"], "left_semi").select("question_id").distinct().withColumn("hit", F.lit(1))
    return asked.select("question_id").distinct().join(met, "question_id", "left").agg(F.count("*").alias("questions"), F.count("hit").alias("hits"))


# ---- geo and report ---------------------------------------------------------------------------------------------------

BOUNDS = """SELECT layer_id, CAST(least(c_custkey % 360 - 180, c_custkey % 90, 2) AS DOUBLE) AS min_lon, CAST(least(c_custkey % 170 - 85, 1.5, -(c_custkey % 45)) AS DOUBLE) AS min_lat,
  CAST(greatest(c_custkey % 360 - 180, c_custkey % 90, 2) AS DOUBLE) AS max_lon, CAST(greatest(c_custkey % 170 - 85, 1.5, -(c_custkey % 45)) AS DOUBLE) AS max_lat, 2 AS feature_count FROM (SELECT c_custkey AS layer_id, * FROM customer)"""


@query("SELECT c_custkey AS layer_id, i AS feature_idx, CASE i WHEN 0 THEN 1 ELSE 2 END AS n_positions, 'EPSG:4326' AS crs FROM customer, (VALUES (0), (1)) t(i)")
def scan_geojson(v):
    return S.scan_geojson(v.layers).select("layer_id", "feature_idx", F.size("positions").alias("n_positions"), "crs")


@query("""SELECT c_custkey AS layer_id, i AS feature_idx, j AS place, CAST(CASE WHEN i = 0 THEN c_custkey % 360 - 180 WHEN j = 0 THEN c_custkey % 90 ELSE 2 END AS DOUBLE) AS lon,
  CAST(CASE WHEN i = 0 THEN c_custkey % 170 - 85 WHEN j = 0 THEN 1.5 ELSE -(c_custkey % 45) END AS DOUBLE) AS lat FROM customer, (VALUES (0, 0), (1, 0), (1, 1)) t(i, j)""")
def extract_positions(v):
    rows = v.layers.select("layer_id", F.posexplode(F.array(*[F.get_json_object("geojson", f"$.features[{i}].geometry") for i in range(2)])).alias("feature_idx", "g"))
    rows = rows.select("layer_id", "feature_idx", F.posexplode(G.extract_positions(F.col("g"))).alias("place", "p"))
    return rows.select("layer_id", "feature_idx", "place", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query("""SELECT c_custkey AS layer_id, place, x::DOUBLE AS lon, y::DOUBLE AS lat FROM customer, LATERAL (VALUES (0, c_custkey % 360 - 180, 1), (1, 3, c_custkey % 80), (2, 4, 5), (3, 9, 1), (4, 8, 2), (5, -7, 6.5), (6, c_nationkey, -6), (7, 1, 1)) t(place, x, y)""")
def nested_positions(v):
    """Collections in collections, with bounding boxes and foreign members, a polygon with a hole, and three dimensions."""
    text = F.format_string(
        '{"type":"GeometryCollection","bbox":[90,90,91,91],"geometries":[{"bbox":[10,20,30,40],"type":"Point","coordinates":[%d,1,7]},{"type":"Polygon","note":[[1,2],[3,4]],"coordinates":[[[3,%d],[4,5]],[[9,1],[8,2,3]]],"bbox":[5,5,6,6]},'
        '{"type":"GeometryCollection","geometries":[{"type":"MultiLineString","coordinates":[[[-7,6.5]],[[%d,-6e0]]]},{"type":"Circle","coordinates":[50,50]},{"type":"MultiPolygon","coordinates":[[[[1,1]]]]}]}]}',
        F.col("c_custkey") % 360 - 180, F.col("c_custkey") % 80, F.col("c_nationkey"))
    rows = v.table("customer").select(F.col("c_custkey").alias("layer_id"), F.posexplode(G.extract_positions(text)).alias("place", "p"))
    return rows.select("layer_id", "place", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query(BOUNDS)
def layer_bounds(v):
    return P.layer_bounds(S.scan_geojson(v.layers)).withColumn("feature_count", F.col("feature_count").cast("int"))


@query("SELECT c_custkey AS layer_id, i AS feature_idx, CASE i WHEN 0 THEN c_name ELSE 'line' END AS label FROM customer, (VALUES (0), (1)) t(i)")
def feature_label(v):
    return S.scan_geojson(v.layers).select("layer_id", "feature_idx", G.feature_label(F.col("properties"), F.lit("?")).alias("label"))


@query("SELECT c_custkey AS layer_id, i AS feature_idx, CASE i WHEN 0 THEN 'name=' || c_name || ';segment=' || c_mktsegment ELSE 'label=line' END AS shown, 0 AS more FROM customer, (VALUES (0), (1)) t(i)")
def feature_properties(v):
    shown, more = G.feature_properties(F.col("properties"))
    return S.scan_geojson(v.layers).select("layer_id", "feature_idx", F.array_join(F.transform(shown, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("shown"), more.alias("more"))


@query("SELECT n_nationkey AS layer_id, n AS feature_idx, CAST(n + 1 AS INT) AS place FROM (SELECT c_nationkey AS n_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer) WHERE n < 12")
def top_features(v):
    """Of layers with as many features as a nation has customers."""
    rows = v.table("customer").groupBy(F.col("c_nationkey").alias("layer_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.lit("Feature").alias("type"), F.col("c_custkey").alias("id"))))).alias("f"))
    layers = rows.select("layer_id", F.concat(F.lit('{"type":"FeatureCollection","features":'), "f", F.lit("}")).alias("geojson"))
    return P.top_features(S.scan_geojson(layers)).select("layer_id", "feature_idx", "place")


_values = ", ".join(f"({k}, '{t}', '{w}')" for k, (t, ws) in enumerate(KEYWORDS.items()) for w in (ws or ["\u0001none"]))
COVER = f"kw AS (SELECT * FROM (VALUES {_values}) t(place, sensor_type, word)), cover AS (SELECT c.workspace_id, k.sensor_type, min(k.place) AS place, bool_or(contains(lower(c.content), k.word)) AS covered FROM chunks c, kw k GROUP BY c.workspace_id, k.sensor_type)"
_first = " ".join(f"WHEN '{t}' THEN '{', '.join(ws[:3])}'" for t, ws in KEYWORDS.items())
ITEMS = f"""{COVER}, facts AS (SELECT coalesce(f.workspace_id, s.workspace_id) AS workspace_id, coalesce(f.gis, false) AS gis, coalesce(f.n, 0) AS n_files, coalesce(s.n, 0) AS n_sensors, coalesce(f.indexed, 0) AS indexed, coalesce(f.pending, 0) AS pending
  FROM (SELECT workspace_id, bool_or(file_type IN ('geojson', 'shapefile')) AS gis, count(*) AS n, count(*) FILTER (WHERE file_type IN ('pdf', 'docx') AND processing_status = 'done') AS indexed,
    count(*) FILTER (WHERE file_type IN ('pdf', 'docx') AND coalesce(processing_status, 'pending') NOT IN ('done', 'error')) AS pending FROM files GROUP BY workspace_id) f
  FULL JOIN (SELECT workspace_id, count(*) AS n FROM sensors GROUP BY workspace_id) s ON f.workspace_id = s.workspace_id),
grid AS (SELECT a.workspace_id, k.place, k.sensor_type, EXISTS (SELECT 1 FROM sensors s WHERE s.workspace_id = a.workspace_id AND s.sensor_type = k.sensor_type) AS has,
  EXISTS (SELECT 1 FROM cover c WHERE c.workspace_id = a.workspace_id AND c.sensor_type = k.sensor_type AND c.covered) AS sop FROM facts a, (SELECT DISTINCT place, sensor_type FROM kw) k),
items AS (SELECT workspace_id, place, CASE WHEN has AND sop THEN 'covered' WHEN has THEN 'gap' ELSE 'warning' END AS kind,
  CASE WHEN has AND sop THEN sensor_type || ': sensor and procedure' WHEN has THEN sensor_type || ': sensor without procedure; look for ' || CASE sensor_type {_first} END ELSE sensor_type || ': procedure without sensor' END AS item FROM grid WHERE has OR sop
  UNION ALL SELECT workspace_id, 8, CASE WHEN gis THEN 'covered' ELSE 'gap' END, CASE WHEN gis THEN 'map data present' ELSE 'no map data' END FROM facts
  UNION ALL SELECT workspace_id, 9, 'covered', CAST(indexed AS VARCHAR) || ' documents indexed' FROM facts WHERE indexed > 0
  UNION ALL SELECT workspace_id, 10, 'warning', CAST(pending AS VARCHAR) || ' documents pending' FROM facts WHERE pending > 0
  UNION ALL SELECT workspace_id, 11, 'gap', 'no files' FROM facts WHERE n_files = 0 UNION ALL SELECT workspace_id, 12, 'warning', 'no sensors' FROM facts WHERE n_sensors = 0)"""


@query(f"WITH {COVER} SELECT workspace_id, sensor_type, covered FROM cover")
def keyword_coverage(v):
    return P.keyword_coverage(v.chunks, KEYWORDS)


@query(f"WITH {WORDS_ASKED}, kw AS (SELECT CAST(length(keyword) AS VARCHAR) AS sensor_type, lower(keyword) AS word FROM keywords), texts AS (SELECT workspace_id, lower(content) AS low FROM chunks), kinds AS (SELECT DISTINCT sensor_type FROM kw), spaces AS (SELECT DISTINCT workspace_id FROM chunks),"
    " yes AS (SELECT DISTINCT workspace_id, sensor_type FROM texts JOIN kw ON contains(low, word)) SELECT s.workspace_id, k.sensor_type, y.sensor_type IS NOT NULL AS covered FROM spaces s CROSS JOIN kinds k LEFT JOIN yes y ON s.workspace_id = y.workspace_id AND k.sensor_type = y.sensor_type")
def keyword_coverage_many(v):
    """The benchmark's words by their lengths, some hundreds to thousands of keywords, in the texts of every workspace."""
    words = v.table("benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).where(F.length("w") > 3).select(F.length("w").alias("n"), F.lower("w").alias("w")).distinct()
    keywords = {}
    for r in words.collect():
        keywords.setdefault(str(r["n"]), []).append(r["w"])
    return P.keyword_coverage(v.chunks, keywords)


@query(f"WITH {ITEMS} SELECT workspace_id, CAST(place AS INT) AS place, kind, item FROM items")
def readiness_items(v):
    return P.readiness_items(v.files, v.sensors, v.chunks, KEYWORDS)


@query(f"""WITH {ITEMS} SELECT workspace_id, CAST(round_even(100.0 * count(*) FILTER (WHERE kind = 'covered') / count(*), 0) AS INT) AS score, coalesce(string_agg(item, ';' ORDER BY place) FILTER (WHERE kind = 'covered'), '') AS covered,
  coalesce(string_agg(item, ';' ORDER BY place) FILTER (WHERE kind = 'gap'), '') AS gap, coalesce(string_agg(item, ';' ORDER BY place) FILTER (WHERE kind = 'warning'), '') AS warning FROM items GROUP BY workspace_id""")
def readiness_report(v):
    rows = P.readiness_report(v.files, v.sensors, v.chunks, KEYWORDS)
    return rows.select("workspace_id", "score", *[F.array_join(c, ";").alias(c) for c in ("covered", "gap", "warning")])


# ---- audits and maintenance -------------------------------------------------------------------------------------------

OURS = "ours AS (SELECT doc_id AS document_id, lang FROM documents), stored AS (SELECT * FROM vectors)"


def disk(v):
    """Chunks on disk: the vectors of the labels that the registry knows, with other texts for some."""
    return v.vectors.drop("embedding").withColumn("text", F.when(F.col("document_id") == 4, "changed").otherwise(F.col("text"))).where("document_id <> 7")


DISK = "disk AS (SELECT chunk_id, document_id, CASE WHEN document_id = 4 THEN 'changed' ELSE text END AS text FROM vectors WHERE document_id <> 7)"
COUNTED = f"{DISK}, counted AS (SELECT r.document_id, coalesce(c.n, 0) AS chunks, coalesce(x.n, 0) AS vectors_n FROM registry r LEFT JOIN (SELECT document_id, count(*) AS n FROM disk GROUP BY document_id) c ON r.document_id = c.document_id LEFT JOIN (SELECT document_id, count(*) AS n FROM vectors WHERE embedding[1] < 0.2 GROUP BY document_id) x ON r.document_id = x.document_id)"


@query(f"WITH {COUNTED} SELECT document_id, CASE WHEN chunks = 0 THEN 'WARN' WHEN vectors_n = chunks THEN 'PASS' ELSE 'FAIL(' || CASE WHEN vectors_n > chunks THEN '+' ELSE '' END || CAST(vectors_n - chunks AS VARCHAR) || ')' END AS verdict FROM counted")
def index_count_audit(v):
    return A.index_count_audit(v.registry, disk(v), v.vectors.where("embedding[0] < 0.2")).select("document_id", "verdict")


@query(f"WITH {DISK} SELECT d.document_id, CASE WHEN count(*) = count(CASE WHEN x.embedding[1] < 0.2 THEN 1 END) THEN 'indexed' ELSE 'error' END AS status FROM disk d JOIN vectors x ON d.chunk_id = x.chunk_id GROUP BY d.document_id")
def vector_count_check(v):
    return A.vector_count_check(disk(v), v.vectors.where("embedding[0] < 0.2")).select("document_id", "status")


@query("SELECT chunk_id, document_id <> 4 AS text_ok, document_id <> 4 AS passed FROM vectors WHERE document_id <> 7")
def index_content_audit(v):
    return A.index_content_audit(disk(v), v.vectors).select("chunk_id", "text_ok", "passed")


@query("SELECT chunk_id FROM vectors WHERE document_id = 7")
def stale_vectors(v):
    return A.stale_vectors(disk(v), v.vectors)


@query("SELECT chunk_id FROM vectors WHERE document_id <> 7 AND embedding[1] >= 0.2")
def missing_vectors(v):
    return A.missing_vectors(disk(v), v.vectors.where("embedding[0] < 0.2"))


@query("SELECT min(n) AS min_dim, max(n) AS max_dim, min(n) = 64 AND max(n) = 64 AS matches FROM (SELECT CASE WHEN document_id = 3 THEN 32 ELSE len(embedding) END AS n FROM vectors)")
def embedding_dim_check(v):
    """Half of each vector of one document is cut off."""
    cut = F.when(F.col("document_id") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return A.embedding_dim_check(v.vectors.withColumn("embedding", cut), 64).select(*[F.col(c).cast("long").alias(c) for c in ("min_dim", "max_dim")], "matches")


@query(f"WITH {HITS} SELECT query_id, h.chunk_id, CASE WHEN round(1 - similarity, 6) < 0.5 THEN 'good' ELSE 'far' END AS quality, left(text, 100) AS preview FROM hits h JOIN vectors x ON h.chunk_id = x.chunk_id WHERE rank <= 3")
def distance_quality(v):
    rows = passages(v).withColumn("distance", F.round(1 - F.col("similarity"), 6))
    return A.distance_quality(rows).select("query_id", "chunk_id", "quality", "preview")


@query("""SELECT doc AS document_id, page AS page_num, block AS block_id, '{"k":"' || CAST(block AS VARCHAR) || '"}' AS extra FROM blocks""")
def flatten_chunk_metadata(v):
    meta = F.struct(F.col("doc").alias("document_id"), F.col("page").alias("page_num"), F.col("block").alias("block_id"), F.create_map(F.lit("k"), F.col("block").cast("string")).alias("extra"))
    return A.flatten_chunk_metadata(v.blocks.select(meta.alias("metadata")))


# Of a key that is changed twice, the greatest row counts: the one with the later date, the status that sorts last.
CHANGED = "changed AS (SELECT doc_id AS document_id, 'indexed' AS status FROM documents WHERE lang <> 'de')"


def changes(v):
    return v.table("documents").where("lang <> 'de'").select(F.col("doc_id").alias("document_id"), F.lit("indexed").alias("status"))


@query(f"WITH {CHANGED} SELECT document_id, status, created_at FROM registry WHERE document_id NOT IN (SELECT document_id FROM changed) UNION ALL SELECT document_id, status, DATE '2025-01-01' FROM changed")
def upsert_registry(v):
    new = changes(v).withColumn("created_at", F.lit("2025-01-01").cast("date"))
    twice = new.where("document_id % 3 = 0").withColumn("status", F.lit("chunked"))  # these keys come twice
    return D.upsert_registry(v.registry.select("document_id", "status", "created_at"), new.unionByName(twice))


@query(f"WITH {CHANGED} SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM changed) THEN 'indexed' ELSE status END AS status, true AS known FROM registry UNION ALL SELECT document_id, status, false FROM changed WHERE document_id NOT IN (SELECT document_id FROM registry)")
def set_status(v):
    out, unknown = D.set_status(v.registry, changes(v).unionByName(changes(v).where("document_id % 3 = 0").withColumn("status", F.lit("chunked"))))
    return out.select("document_id", "status", F.lit(True).alias("known")).union(unknown.select("document_id", "status", F.lit(False)))


@query("""SELECT document_id, status FROM registry WHERE document_id NOT IN (SELECT k FROM (SELECT r.document_id AS k, row_number() OVER (PARTITION BY r.file_hash ORDER BY r.created_at, r.document_id) AS n FROM registry r) WHERE n = 1)
  UNION ALL SELECT document_id, 'pending' FROM (SELECT DISTINCT coalesce(k.document_id, min(i.document_id) OVER (PARTITION BY i.file_hash)) AS document_id FROM incoming i LEFT JOIN (SELECT file_hash, document_id, row_number() OVER (PARTITION BY file_hash ORDER BY created_at, document_id) AS n FROM registry) k ON i.file_hash = k.file_hash AND k.n = 1)""")
def ingest_batch(v):
    raw = v.incoming.select("file_hash", "document_id", F.concat(F.lit("f"), F.col("row_id").cast("string")).alias("file_name"), F.lit("2025-01-01").cast("date").alias("created_at"), F.lit(None).cast("string").alias("reject_reason"))
    return D.ingest_batch(raw, v.registry).select("document_id", "status")


@query("""SELECT chunk_id, document_id, 64 AS dim, NULL AS status FROM vectors UNION ALL SELECT chunk_id + 1000000, document_id, 64, NULL FROM vectors WHERE document_id = 2
  UNION ALL SELECT chunk_id, document_id, 32, NULL FROM vectors WHERE document_id = 2 UNION ALL SELECT DISTINCT NULL, document_id, n, 'indexed' FROM vectors, (VALUES (64), (32)) t(n) WHERE document_id = 2""")
def upsert_vectors(v):
    """Vectors of a document come again with as many new ones, and its status; then vectors of half the length, with which the
    table starts anew."""
    two = v.vectors.where("document_id = 2")
    new = two.unionByName(two.withColumn("chunk_id", F.col("chunk_id") + 1000000))
    made = [D.upsert_vectors(v.vectors, new, 64), D.upsert_vectors(v.vectors, two.withColumn("embedding", F.slice("embedding", 1, 32)), 32)]
    rows = [x.select("chunk_id", "document_id", F.size("embedding").alias("dim"), F.lit(None).cast("string").alias("status")) for x, _ in made]
    states = [x.select(F.lit(None).cast("long"), "document_id", F.lit(n), "status") for n, (_, x) in zip((64, 32), made, strict=True)]
    return rows[0].union(rows[1]).union(states[0]).union(states[1])


@query("SELECT file_id, chunk_index FROM chunks WHERE workspace_id <> 'src3' UNION ALL SELECT DISTINCT file_id, 0 FROM chunks WHERE workspace_id = 'src3'")
def replace_file_chunks(v):
    new = v.chunks.where("workspace_id = 'src3' AND chunk_index = 0")
    return D.replace_file_chunks(v.chunks, new).select("file_id", "chunk_index")


GONE = "gone AS (SELECT file_id AS id FROM files WHERE workspace_id = 'src5' UNION ALL SELECT 5000000000)"


@query(f"""WITH {GONE} SELECT 'files' AS name, count(*) AS n, CAST(sum(file_id) AS BIGINT) AS ids FROM files WHERE file_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'registry', count(*), CAST(sum(document_id) AS BIGINT) FROM registry WHERE document_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'vectors', count(*), CAST(sum(document_id) AS BIGINT) FROM vectors WHERE document_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'pages', count(*), CAST(sum(doc) AS BIGINT) FROM blocks WHERE doc NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'chunks', count(*), CAST(sum(file_id) AS BIGINT) FROM chunks WHERE file_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'layers', count(*), CAST(sum(file_id) AS BIGINT) FROM layers WHERE file_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'unknown', 1, 5000000000""")
def delete_cascade(v):
    """Documents leave six tables at once, by one entry; one that no file has is reported."""
    store = ST.Store(v.spark, place(v, "store"))
    tables = {"files": (v.files, "file_id"), "registry": (v.registry, "document_id"), "vectors": (v.vectors, "document_id"), "pages": (v.blocks, "doc"), "chunks": (v.chunks, "file_id"), "layers": (v.layers, "file_id")}
    for name, (rows, by) in tables.items():
        store.create(name, rows, by, buckets=16)
    gone = v.files.where("workspace_id = 'src5'").select(F.col("file_id").alias("id")).union(v.spark.createDataFrame([(5_000_000_000,)], "id long"))
    unknown = store.delete_owned(gone, "files")
    counts = [store.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(by).alias("ids")) for name, (_, by) in tables.items()]
    return reduce(DataFrame.union, [*counts, unknown.agg(F.lit("unknown"), F.count("*"), F.sum("id"))])


@query("""SELECT document_id, CASE WHEN document_id % 100 = 1 THEN 'indexed' ELSE status END AS status, document_id % 100 = 1 AS changed, true AS kept FROM registry""")
def upsert_buckets(v):
    """One document in a hundred changes its status in a table of 4096 buckets: files of the others stay as they are."""
    store = ST.Store(v.spark, place(v, "store"))
    store.create("registry", v.registry.select("document_id", "status"), "document_id", buckets=4096)
    before = store.state()[1]["registry"]["files"]
    new = v.registry.where("document_id % 100 = 1").select("document_id", F.lit("indexed").alias("status"))
    done = store.upsert("registry", new, "document_id")
    after = store.state()[1]["registry"]["files"]
    stays = all(after[b] == fs for b, fs in before.items() if int(b) not in done) and len(done) <= new.count()
    return store.read("registry").select("document_id", "status", (F.col("document_id") % 100 == 1).alias("changed"), F.lit(stays).alias("kept"))


@query("""SELECT chunk_id, document_id, false AS without FROM vectors WHERE document_id NOT IN (1, 2, 5) UNION ALL SELECT chunk_id + 1000000, document_id, false FROM vectors WHERE document_id IN (1, 2)
  UNION ALL SELECT NULL, document_id, true FROM (SELECT DISTINCT document_id FROM vectors WHERE document_id = 5)""")
def reindex(v):
    """Stored chunks have new ids; one document has none."""
    ids = v.vectors.where("document_id IN (1, 2, 5)").select("document_id").distinct()
    stored = v.vectors.where("document_id <> 5").withColumn("chunk_id", F.col("chunk_id") + 1000000)
    out, without = D.reindex(v.vectors, stored, ids, 64)
    return out.select("chunk_id", "document_id", F.lit(False).alias("without")).union(without.select(F.lit(None).cast("long"), "document_id", F.lit(True)))


@query("""SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 10 ELSE length(geojson) END AS n, true AS same_id FROM layers UNION ALL SELECT file_id + 100000, 10, false FROM layers WHERE file_id % 2 = 0""")
def upsert_layer(v):
    """Every second layer is replaced without naming its id, and comes as a new file too, twice, under an id that no layer has."""
    new = v.layers.where("file_id % 2 = 0").withColumns({"layer_id": F.lit(None).cast("long"), "geojson": F.lit('{"a":"b"}\n')})
    more = new.withColumn("file_id", -1 - F.col("file_id"))
    out = D.upsert_layer(v.layers, new.unionByName(more).unionByName(more))
    shown = F.when(F.col("file_id") < 0, 99999 - F.col("file_id")).otherwise(F.col("file_id"))
    return out.select(shown.alias("file_id"), F.length("geojson").cast("long").alias("n"), (F.col("layer_id") == F.col("file_id")).alias("same_id"))


@query("SELECT file_id, CASE WHEN workspace_id = 'src1' THEN 'pending' ELSE processing_status END AS processing_status FROM files")
def upsert_file(v):
    files = v.files.withColumn("status", F.lit("old"))
    return D.upsert_file(files, files.where("workspace_id = 'src1'")).select("file_id", "processing_status")


@query("SELECT sensor_id, CASE WHEN sensor_type = 'GAS' THEN sensor_id + 7 ELSE linked_file_id END AS linked_file_id FROM sensors")
def link_sensor(v):
    return D.link_sensor(v.sensors, v.sensors.where("sensor_type = 'GAS'").select("sensor_id", F.explode(F.array(F.lit(7), F.lit(3))).alias("k")).select("sensor_id", (F.col("sensor_id") + F.col("k")).alias("linked_file_id"))).select("sensor_id", "linked_file_id")


@query("SELECT tag_id, NULL AS color FROM tags UNION ALL SELECT tag_id + 1000000, '#ef4444' FROM tags WHERE workspace_id = 'src1'")
def add_rows(v):
    old = v.tags.withColumn("color", F.lit(None).cast("string"))
    new = v.tags.where("workspace_id = 'src1'").withColumn("tag_id", F.col("tag_id") + 1000000)
    return D.add_rows(old, new, {"color": F.lit("#ef4444")}).select("tag_id", "color")


@query("SELECT tag_id FROM tags WHERE workspace_id <> 'src2'")
def delete_rows(v):
    return D.delete_rows(v.tags, v.tags.where("workspace_id = 'src2'"), "tag_id").select("tag_id")


# ---- files and streams ------------------------------------------------------------------------------------------------


def place(v, name: str) -> str:
    """A new folder below the one that all machines share."""
    return new_path(v.spark, name)


@query("SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'indexed' ELSE status END AS status FROM registry")
def replace_table(v):
    """A registry is stored, then replaced; further versions are written by jobs that die before the entry, with the entry half
    written, and before it has its name."""
    out, registry = place(v, "registry"), v.registry.select("document_id", "status")
    D.replace_table(registry, out)
    D.replace_table(D.set_status(registry, registry.where("document_id % 2 = 0").withColumn("status", F.lit("indexed")))[0], out)
    registry.limit(0).write.parquet(f"{out}/v-half-written")
    for name, text in ((".draft-1", "v-half-written"), ("000000002", ""), ("000000003", "v-half-wri")):
        fs, entry = file_system(v.spark, f"{out}/manifest/{name}")
        stream = fs.create(entry, True)
        stream.write(text.encode())
        stream.close()
    return D.read_table(v.spark, out)


@query("SELECT doc_id AS document_id, lang, source, n_chars, doc_id % 500 = 3 AS looked_up FROM documents UNION ALL SELECT doc_id, lang, source, n_chars, NULL FROM documents WHERE doc_id % 500 = 3")
def write_partitioned_json(v):
    """Documents written as JSON into buckets and read back; some of them looked up, from their buckets alone."""
    out = place(v, "json")
    rows = v.table("documents").select(F.col("doc_id").alias("document_id"), "lang", "source", "n_chars")
    S.write_json(rows, out)
    every = S.read_json(v.spark, out, rows.schema)
    some = S.read_json(v.spark, out, rows.schema, [r[0] for r in rows.where("document_id % 500 = 3").select("document_id").collect()])
    return every.withColumn("looked_up", F.col("document_id") % 500 == 3).unionByName(some.withColumn("looked_up", F.lit(None).cast("boolean")))


@query("SELECT c_custkey, c_name, '[' || CAST(c_nationkey AS VARCHAR) || ',1]' AS pages FROM customer")
def write_eval_csv(v):
    out = place(v, "csv")
    S.write_eval_csv(v.table("customer").select("c_custkey", "c_name", F.array("c_nationkey", F.lit(1)).alias("pages")), out)
    return v.spark.read.option("header", True).schema("c_custkey long, c_name string, pages string").csv(out)


@query("SELECT 'not a PDF' AS reject_reason, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents")
def scan_raw_files(v):
    """Documents written as text files, one a line, and scanned as bytes: none is a PDF."""
    out = place(v, "raw")
    S.write_texts(v.table("documents").select("text"), out)
    return S.validate_pdf(S.scan_raw_files(v.spark, f"{out}/part-*")).groupBy("reject_reason").agg(F.sum("length").alias("bytes"))


@query("""SELECT id, CASE WHEN length = 0 THEN 'empty' WHEN length > 104857600 THEN 'too large' WHEN content NOT LIKE '\\%PDF%' ESCAPE '\\' THEN 'not a PDF' END AS reject_reason FROM uploads
  UNION ALL SELECT id + 1000000, 'empty or missing' FROM uploads WHERE id % 10 = 0""")
def validate_pdf(v):
    """Good, empty, too large and other files, and ones that are expected and missing, under names that no file has."""
    files = v.uploads.withColumns({"content": F.col("content").cast("binary"), "file_name": F.col("id").cast("string")}).drop("id")
    expected = v.uploads.select(F.col("id").cast("string").alias("file_name")).union(v.uploads.where("id % 10 = 0").select(F.concat(F.lit("missing "), F.col("id").cast("string"))))
    shift = F.when(F.startswith("file_name", F.lit("missing ")), 1000000).otherwise(0)
    return S.validate_pdf(files, expected).select((F.regexp_extract("file_name", "[0-9]+", 0).cast("long") + shift).alias("id"), "reject_reason")


@query("""SELECT CAST(doc AS VARCHAR) AS doc, page, block, text, type, ratio_to_body::DOUBLE AS ratio_to_body, 10.0::DOUBLE AS median_font_size FROM blocks""")
def scan_ocr_json(v):
    """Blocks written as page files, one a document, and scanned again."""
    out = place(v, "ocr")
    block = F.struct("block", F.struct("text", "type", *[F.col(c).cast("double").alias(c) for c in ("y_top", "y_bottom", "font_size", "ratio_to_body")], "line_count").alias("b"))
    pages = v.blocks.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))
    stats = F.struct(F.lit(10.0).alias("median_font_size"), F.lit(13.0).alias("max_font_size")).alias("stats")
    docs = pages.groupBy(F.col("doc").cast("string").alias("file_name")).agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page_num"), stats, "blocks"))).alias("pages"))
    docs.select(F.to_json(F.struct("file_name", "pages")).alias("value")).write.text(out)
    return S.scan_ocr_json(v.spark, out, lines=True).select("doc", F.col("page").cast("long").alias("page"), "block", "text", "type", "ratio_to_body", "stats.median_font_size")


@query("SELECT CAST(document_id AS VARCHAR) AS document_id, file_name, status, CAST(created_at AS TIMESTAMP) AS created_at, file_hash FROM registry")
def scan_registry_json(v):
    """The registry written as JSON maps, one a line, and scanned again."""
    out, r = place(v, "registry-json"), v.registry
    record = F.struct(F.col("document_id").cast("string").alias("document_id"), "file_name", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "file_hash")
    parts = r.select(F.concat(F.lit('"'), F.col("document_id").cast("string"), F.lit('":'), F.to_json(record)).alias("e"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("e"), F.lit(-(-r.count() // 1000))))  # files of about a thousand records
    parts.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ","), F.lit("}")).alias("value")).drop("part").write.text(out)
    return S.scan_registry_json(v.spark, out, lines=True).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("""SELECT CAST(item_id AS VARCHAR) AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'number' END AS metric_focus, CASE WHEN item_id % 2 = 1 THEN 'in_context' END AS query_type,
  CASE WHEN item_id % 3 = 0 AND item_id % 2 = 1 THEN '' ELSE CAST(item_id % 7 AS VARCHAR) || CASE WHEN item_id % 2 = 0 THEN ',9' ELSE '' END END AS pages FROM benchmark""")
def scan_golden(v):
    """Golden questions in both shapes, written and scanned again: by pages, and by document with or without a page."""
    out, b = place(v, "golden"), v.table("benchmark")
    first = b.where("item_id % 2 = 0").select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("number").alias("metric_focus"), F.col("text").alias("question"), F.array((F.col("item_id") % 7).cast("int"), F.lit(9)).alias("expected_pages"))).alias("value"))
    page = F.when(F.col("item_id") % 3 != 0, (F.col("item_id") % 7).cast("int")).alias("expected_page")
    second = b.where("item_id % 2 = 1").select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit("in_context").alias("query_type"), page)).alias("value"))
    first.unionByName(second).write.text(out)
    return S.scan_golden(v.spark, out, lines=True).select("id", "question", "metric_focus", "query_type", F.coalesce(F.array_join("expected_pages", ","), F.lit("")).alias("pages"))


@query("SELECT DISTINCT doc AS document_id, text FROM (SELECT CAST(doc_id AS VARCHAR) AS doc, text FROM documents)")
def scan_chunks_json(v):
    """Documents written as chunks, one a line, and scanned again."""
    out = place(v, "chunks")
    d = v.table("documents").select(F.col("doc_id").cast("string").alias("d"), "text")
    meta = F.struct(F.col("d").alias("document_id"), F.lit(1).alias("page_num"))
    chunk = F.struct(F.concat("d", F.lit("_1_0_0")).alias("chunk_id"), F.col("d").alias("document_id"), F.lit(1).alias("page"), "text", meta.alias("metadata"))
    d.select(F.to_json(chunk).alias("value")).write.text(out)
    return S.scan_chunks_json(v.spark, out, lines=True).select("document_id", "text")


def stream_of(v, name: str):
    return v.spark.readStream.schema(v.table(name).schema).parquet(f"{v.sf_dir}/{name}.parquet*")


def states_of(events):
    kinds = {"signup": "pending", "view": "ocr_completed", "click": "chunked", "purchase": "indexed"}
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type")), F.lit("error"))
    return events.select("event_id", F.col("user_id").alias("document_id"), "ts", status.alias("status"))


def in_parts(v, events, n: int = 3):
    """The events as a stream of n batches, dealt by a hash, then one that is far in the future."""
    out, parts = place(v, "events"), [events.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == k) for k in range(n)]
    last = events.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("document_id"), (F.max("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts"), F.lit("error").alias("status"))
    for k, part in enumerate([*parts, last]):
        part.select("event_id", "document_id", "ts", "status").coalesce(1).write.parquet(f"{out}/{k}")
    return v.spark.readStream.schema(events.select("event_id", "document_id", "ts", "status").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/*")


@query("SELECT document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS n FROM events_status) WHERE n = 1")
def status_stream(v):
    """The events as a stream that comes out of order, folded to the latest status in a table of buckets."""
    store = ST.Store(v.spark, place(v, "store"))
    J.status_stream(in_parts(v, states_of(v.table("events"))), store, "status", place(v, "checkpoint")).awaitTermination()
    return store.read("status").where("document_id >= 0").select("document_id", "status")


@query("""SELECT document_id, event_id, status, status = 'error' OR (CASE status WHEN 'pending' THEN 0 WHEN 'ocr_completed' THEN 1 WHEN 'chunked' THEN 2 WHEN 'indexed' THEN 3 END) =
  1 + (CASE lag(status) OVER (PARTITION BY document_id ORDER BY ts, event_id) WHEN 'pending' THEN 0 WHEN 'ocr_completed' THEN 1 WHEN 'chunked' THEN 2 WHEN 'indexed' THEN 3 ELSE -1 END) AS legal FROM events_status""")
def flag_transitions(v):
    """Events that come out of order, in three batches, are judged in the order of their times."""
    out = place(v, "steps")
    steps = J.flag_transitions(in_parts(v, states_of(v.table("events")).withColumn("ts", F.col("ts").cast("timestamp"))), "4000 days")
    steps.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema("document_id long, event_id long, status string, legal boolean").parquet(f"{out}/data").where("document_id >= 0")


def paragraphs_of(doc: dict) -> list[tuple]:
    if doc["file_hash"] < "1":
        raise ValueError("unreadable")
    return [(doc["document_id"], k, p) for k, p in enumerate(K.paragraphs(doc["text"] or ""))]


@query("SELECT sha256(coalesce(text, '')) AS file_hash, CASE WHEN sha256(coalesce(text, '')) < '1' THEN 'error' ELSE 'indexed' END AS status, CASE WHEN sha256(coalesce(text, '')) < '1' THEN 'ValueError: unreadable' END AS error FROM documents GROUP BY 1")
def ingest_stream(v):
    """Documents as a stream, distinct by content, cut into paragraphs and stored; the work fails for one in sixteen. The states of all."""
    out = place(v, "ingest")
    docs = stream_of(v, "documents").select(F.col("doc_id").alias("document_id"), F.current_timestamp().alias("arrived"), "text")
    J.ingest_stream(docs, out, f"{out}/checkpoint", J.each_document(paragraphs_of, "document_id long, idx int, chunk string")).awaitTermination()
    return v.spark.read.schema(J.STATES.format(kind="long")).parquet(f"{out}/states").select("file_hash", "status", "error").distinct()
