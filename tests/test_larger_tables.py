"""Queries on tables with larger keys, longer texts or more rows than the driver's smallest ones."""

import math

import duckdb
import numpy as np
import pytest

from quire.operators import retrieval, text_index, vector_search
from quire.plans import QUERIES, SQL, retrieval_queries
from quire.sources import files as S
from quire.sources import staging
from tests.test_oracle import DATA, plain


def same_rows(spark, folder, name, **tables):
    """A query over tables made by DuckDB's SQL gives the rows of its own SQL, which come back."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    rows = sorted(tuple(plain(x) for x in r) for r in got.fetchall())
    assert rows == sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    return rows


def test_validate_pdf_with_large_keys(spark, tmp_path):
    """Files whose ids lie a million apart: what is missing shares no name with them."""
    parts = "SELECT k AS p_partkey, 'name' AS p_name, 1 AS p_size FROM (SELECT i + 1000000 * j AS k FROM range(40) a(i), range(3) b(j))"
    assert len(same_rows(spark, tmp_path, "validate_pdf", part=parts)) == 132


def test_expected_files_listed_twice(spark):
    files = spark.createDataFrame([("a", 5, b"%PDF-"), ("b", 2, b"PK")], "file_name string, length long, content binary")
    expected = spark.createDataFrame([("a",), ("a",), ("c",), ("c",)], "file_name string")
    assert sorted(map(tuple, S.validate_pdf(files, expected).select("file_name", "reject_reason").collect())) == [("a", None), ("b", "not a PDF"), ("c", "empty or missing")]


def test_upsert_layer_with_large_keys(spark, tmp_path):
    """Layers whose ids lie 100,000 apart: each new file is one of its own."""
    customers = "SELECT i + 100000 * j AS c_custkey, 'name' AS c_name, 'kind' AS c_mktsegment FROM range(10) a(i), range(3) b(j)"
    assert len(same_rows(spark, tmp_path, "upsert_layer", customer=customers)) == 45


def test_scan_raw_files_of_many_texts_in_one_partition(spark, tmp_path):
    """110 MB in one row group, so that one task writes them: no file is too large. Of 40 bytes each and of 100,000, and null ones."""
    documents = "SELECT i AS doc_id, CASE WHEN i % 100 = 1 THEN NULL WHEN i < 100000 THEN repeat('abcd', 10) ELSE repeat('x', 100000) END AS text FROM range(101060) t(i)"
    assert same_rows(spark, tmp_path, "scan_raw_files", documents=documents) == [("not a PDF", str(40 * 99000 + 1049 * 100000 + 101060))]


def test_texts_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "LONG", 10)
    monkeypatch.setattr(S, "FILE_BYTES", 100)
    S.write_texts(spark.createDataFrame([("é" * (k % 5),) for k in range(50)] + [("y" * 40,), ("z" * 300,), (None,)], "t string").coalesce(1), f"{tmp_path}/texts")
    rows = spark.read.text(f"{tmp_path}/texts")
    assert sorted(r[0] for r in rows.collect()) == sorted(["é" * (k % 5) for k in range(50)] + ["y" * 40, "z" * 300, ""])
    sizes = [r["length"] for r in S.scan_raw_files(spark, f"{tmp_path}/texts/part-*").select("length").collect()]
    assert max(sizes) == 301 and sorted(sizes)[-2] <= 100 and len(sizes) == 7


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_search_holds_tiles_only(spark, metric, monkeypatch):
    """No array of scores is larger than a tile, of 700 queries and as many vectors with many copies; results are those of one large product."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(4, 8)), 90, 0), np.zeros((40, 8))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vector_search, "TILE", 64, raising=False)
    monkeypatch.setattr(vector_search, "ROWS", 50, raising=False)

    def small(f):
        def held(q, x, *more):
            assert len(q) <= 64 and len(x) <= 50, f"{len(q)} x {len(x)} scores"
            return f(q, x, *more)

        return held

    monkeypatch.setattr(vector_search, "METRICS", {k: small(f) for k, f in vector_search.METRICS.items()})
    if hasattr(vector_search, "rough_scores"):
        monkeypatch.setattr(vector_search, "rough_scores", small(vector_search.rough_scores))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["similarity"]) for r in vector_search.knn_exact(rows.withColumnRenamed("vec_id", "query_id"), rows, 5, metric).collect()}
    size = np.linalg.norm(v, axis=1)
    s = np.divide(v @ v.T, np.outer(size, size), out=np.zeros((700, 700)), where=np.outer(size, size) > 0) if metric == "cosine" else -((v[:, None] - v[None]) ** 2).sum(2)
    for i, row in enumerate(np.round(s, 9)):
        best = np.lexsort((np.arange(700), -row))[:5]
        assert [got[i, n + 1][0] for n in range(5)] == best.tolist()
        assert np.allclose([got[i, n + 1][1] for n in range(5)], row[best], atol=1e-8)
    assert len(got) == 3500


def test_many_candidates_are_not_multiplied_by_words(spark, tmp_path, monkeypatch):
    """BM25 of more candidates than are broadcast: no table that is written has a row for each pair and word; a pair that is listed
    twice, texts without words and ones that the index lacks are scored as they are."""
    texts = {f"t{i}": " ".join(f"w{(i * j) % 17}" for j in range(i % 12)) for i in range(60)}
    asked = {q: [f"w{(q + j) % 20}" for j in range(9)] for q in range(3)}
    index = text_index.add_to_index(spark.createDataFrame(list(texts.items()), "chunk_id string, text string"), f"{tmp_path}/ix", buckets=4)
    pairs = [(q, t) for q in asked for t in texts] + [(0, "t5"), (1, "missing")]
    written, stage = [], text_index.staged

    def counting(df, *more):
        written.append((out := stage(df, *more)).count())
        return out

    monkeypatch.setattr(text_index, "staged", counting)
    monkeypatch.setattr(text_index, "BROADCAST_ROWS", 100)
    candidates = spark.createDataFrame([(q, t, {"n": n}, n) for n, (q, t) in enumerate(pairs)], "query_id long, chunk_id string, m map<string,int>, rank int")
    queries = spark.createDataFrame([(q, " ".join(ws)) for q, ws in asked.items()], "query_id long, query string")
    words = {t: x.split() for t, x in texts.items()}
    mean = sum(map(len, words.values())) / 60

    def score(q, t):
        ws, total = words.get(t, []), 0.0
        for w in set(asked[q]):
            df, tf = sum(w in x for x in words.values()), ws.count(w)
            total += math.log(1 + (60 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) if tf else 0
        return round(total, 6)

    for rows in (candidates, candidates.drop("m")):
        got = text_index.bm25_scores(rows, queries, index).collect()
        assert sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["bm25"], 6)) for r in got) == sorted((q, t, n, score(q, t)) for n, (q, t) in enumerate(pairs))
        assert max(written) <= len(pairs)


def test_words_of_a_text_are_counted_in_its_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["x"],), (None,)], "t array<string>").select(text_index.counted(text_index.F.col("t")).alias("c")).collect()
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in rows] == [[("a", 1), ("b", 3)], None, [("x", 1)], None]


@pytest.mark.parametrize("name", ["recall_of_passages", "two_stage_search"])
def test_vectors_of_lines_are_not_stored(spark, name, monkeypatch):
    """Lines are embedded on their way to the queries: no table that is written has a vector for each."""
    kinds, stage = [], staging.staged
    for module in (retrieval, text_index, retrieval_queries, vector_search):
        monkeypatch.setattr(module, "staged", lambda df, *more: kinds.extend(t for _, t in df.dtypes) or stage(df, *more), raising=False)
    assert QUERIES[name](spark, DATA).count() and kinds and "array<double>" not in kinds
