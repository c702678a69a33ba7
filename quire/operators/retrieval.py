"""Vector and keyword retrieval, prompts and evaluation, for whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.vector import cosine
from quire.operators.catalog import chunks_with_files, rank_hits
from quire.operators.embedding import embed_batches, embed_cached, hashing_embed  # noqa: F401
from quire.operators.keywords import keyword_hits  # noqa: F401
from quire.operators.text_index import BROADCAST_ROWS, TextIndex, bm25_scores, texts_with
from quire.operators.vector_search import VectorIndex, knn_approx, knn_exact, search_vectors  # noqa: F401
from quire.sources.staging import staged

# Candidates of the first stage, limits of top_k, page offset of the golden questions.
CANDIDATES, DEFAULT_K, MOST_K, PAGE_OFFSET = 20, 5, 50, 31


def semantic_search(chunks: DataFrame, files: DataFrame, workspace: str, query: list[float], k: int = DEFAULT_K, least: float = 0.1) -> DataFrame:
    """The k nearest chunks of a workspace, then those above `least`; the score is rounded last. Chunks without a vector are skipped."""
    rows = chunks_with_files(chunks.where("embedding is not null"), files, workspace)
    scored = rows.withColumn("raw", cosine(F.col("embedding"), F.array(*map(F.lit, query))))
    best = scored.orderBy(F.desc("raw"), "chunk_id").limit(k).where(F.col("raw") > least)
    return best.withColumn("score", F.round("raw", 4)).drop("raw")


def keyword_search(chunks: DataFrame, files: DataFrame, workspace: str, query: str, k: int = DEFAULT_K) -> DataFrame:
    """The first k chunks that hold the whole query, whatever the case; score 1."""
    rows = chunks_with_files(chunks, files, workspace).where(F.contains(F.lower("content"), F.lit(query.lower())))
    return rows.withColumn("score", F.lit(1.0)).orderBy("file_id", "chunk_index").limit(k)


def documents_with(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "item_id", text: str = "text") -> DataFrame:
    """passage_id, doc_id of every document that holds a passage, sign by sign. Empty passages are in no document."""
    return texts_with(docs, passages, doc_id, text, passage_id, text)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words(text))) / F.size(q))


def rerank(candidates: DataFrame, k: int, scorer: Column | None = None, query_key: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The k best by the scorer, whose score replaces the first; where it has none the old order and score stay."""
    new = F.lit(None).cast("double") if scorer is None else scorer.cast("double")
    rows = candidates.withColumn("new", new).withColumn("by", F.coalesce("new", -F.col("rank")))
    rows = rank_hits(rows.drop("rank"), query_key, "by", k, item)
    return rows.withColumn("score", F.coalesce("new", "score")).drop("new", "by")


def rerank_bm25(candidates: DataFrame, queries: DataFrame, index: TextIndex, k: int, query_key: str = "query_id", item: str = "chunk_id", text: str = "query") -> DataFrame:
    """The k best candidates of each query by BM25 over an index of all texts. Candidates that share no word with their query come
    last, in their old order."""
    rows = bm25_scores(candidates, queries, index, item, query_key, text)
    return rerank(rows, k, F.when(F.col("bm25") > 0, F.col("bm25")), query_key, item).drop("bm25")


def two_stage_search(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_K, scorer: Callable[[Column, Column], Column] = token_overlap, where: Column | None = None, index: TextIndex | None = None, cells: VectorIndex | None = None, texts: DataFrame | None = None) -> DataFrame:
    """queries (query_id, query, embedding) against vectors (chunk_id, text, embedding, ...): CANDIDATES by vector, or k if that
    is more, then the k best by the scorer, or with `index` by BM25. With `cells` the first stage is the approximate search.
    texts: the vectors' other columns, where vectors are made on the way and not stored (for each block of queries anew)."""
    texts = vectors.drop("embedding") if texts is None else texts
    n = max(CANDIDATES, k)
    near = search_vectors(queries, cells, n) if cells else knn_exact(queries, vectors, n, vector_id="chunk_id", where=where)
    near = near.withColumnRenamed("vec_id", "chunk_id").withColumnRenamed("similarity", "score")
    if index:
        best = staged(rerank_bm25(near, queries, index, k))
        best = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best  # texts are not moved
        return best.join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id")
    rows = near.join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id")
    return rerank(rows, k, scorer(F.col("query"), F.col("text")))


def cited_sources(hits: DataFrame) -> DataFrame:
    """Distinct (document, page) of each query's hits, in the order in which they come first."""
    first = hits.groupBy("query_id", "document_id", "page").agg(F.min("rank").alias("first"))
    return rank_hits(first, "query_id", "first", 1 << 30, "document_id", descending=False).withColumnRenamed("rank", "place")


def context_block(hits: DataFrame) -> DataFrame:
    """Per query: numbered passages under document and page, a rule between them."""
    passage = F.format_string("[%d] Document: %s, page %s\n%s", F.col("rank"), F.col("document_id").cast("string"), F.col("page").cast("string"), F.col("text"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))).alias("ps"))
    return rows.select("query_id", F.size("ps").alias("n_passages"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n---\n\n").alias("context"))


TEMPLATE = "Question: %s\n\nPassages: %d\n\n%s\n\nAnswer from the passages alone and cite them."


def build_prompts(questions: DataFrame, hits: DataFrame, template: str = TEMPLATE, nothing: str = "(no passages found)") -> DataFrame:
    rows = questions.join(context_block(hits), "query_id", "left")
    return rows.select("query_id", F.format_string(template, "query", F.coalesce("n_passages", F.lit(0)), F.coalesce("context", F.lit(nothing))).alias("prompt"))


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = queries.withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULT_K)))
    ok = F.coalesce((F.trim("query") != "") & F.col("top_k").between(1, MOST_K), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def retrieval_hits(golden: DataFrame, hits: DataFrame, offset: int = PAGE_OFFSET) -> DataFrame:
    """golden (question_id, metric_focus, expected_pages) with adjusted and retrieved pages and whether they meet."""
    pages = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]).alias("retrieved_pages"))
    rows = golden.join(pages, "question_id", "left").withColumn("retrieved_pages", F.coalesce("retrieved_pages", F.array().cast("array<int>")))
    rows = rows.withColumn("adjusted_pages", F.transform("expected_pages", lambda p: (p + offset).cast("int")))
    return rows.withColumn("success", F.coalesce(F.arrays_overlap("adjusted_pages", "retrieved_pages"), F.lit(False)))


def recall_at_k(hits: DataFrame, by: str | None = None) -> DataFrame:
    return hits.groupBy(*([by] if by else [])).agg(F.count("*").alias("questions"), F.count_if("success").alias("hits"), F.round(F.avg(F.col("success").cast("int")) * 100, 4).alias("recall"))


def eval_rows(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """golden (question_id, query_type, expected_doc, expected_page) with recall_hit; null for out_of_context."""
    rows = golden.join(hits.select("question_id", "document_id", "page"), "question_id", "left")
    met = (F.col("document_id") == F.col("expected_doc")) & (F.col("expected_page").isNull() | (F.col("page") == F.col("expected_page")))
    out = rows.groupBy("question_id", "query_type").agg(F.coalesce(F.bool_or(met), F.lit(False)).alias("any"))
    return out.select("question_id", "query_type", F.when(F.col("query_type") != "out_of_context", F.col("any")).alias("recall_hit"))
