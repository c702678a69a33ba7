"""Word, gram and vector indexes, the bucketed store and embeddings against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import embedding, keywords, report, retrieval, tables, text_index, vector_search
from quire.operators.store import Store
from quire.sources import files as S


def texts():
    rng = random.Random(3)
    words = ["the", "of"] * 6 + [f"w{i}" for i in range(40)] + ["Straße", "é", "x-y", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(300)]
    return rows + [(400, None), (401, ""), (402, " .. "), (403, "the " * 3000 + "w1"), (404, "rare the"), (405, "rare the"), (None, "rare rare rare")]


ASKED = [(1, "the w1 W2 of of"), (2, "rare THE"), (3, ""), (4, None), (5, "unheard words"), (6, " ".join(f"w{i}" for i in range(40))), (7, "日本 straße é"), (8, "the")]
TOKENS = re.compile(r"[^\W_]+").findall


def brute_bm25(rows, asked, k):
    rows = [(i, TOKENS((t or "").lower())) for i, t in rows if i is not None]
    mean = sum(len(w) for _, w in rows) / len(rows)
    df = collections.Counter(w for _, ws in rows for w in set(ws))
    out = {}
    for q, text in asked:
        scores = []
        for i, ws in rows:
            tf = collections.Counter(ws)
            both = set(TOKENS((text or "").lower())) & set(ws)
            if both:
                idf = lambda w: math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
                scores.append((-round(sum(idf(w) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in both), 6), i))
        out |= {(q, i): (r, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("seeds, half, most", [(20_000, 0.5, 500_000), (3, 0.5, 0), (5, 1.0, 500_000), (1, 0.0, 0)])
def test_bm25(spark, tmp_path, monkeypatch, seeds, half, most):
    for name, value in (("SEED_POSTINGS", seeds), ("HALF", half), ("BROADCAST_ROWS", most), ("TRIED", 1)):
        monkeypatch.setattr(text_index, name, value)
    rows = spark.createDataFrame(texts(), "chunk_id long, text string")
    index = text_index.add_to_index(rows.where("chunk_id % 3 = 0"), str(tmp_path), buckets=8)
    index = text_index.add_to_index(rows.where("chunk_id is null or chunk_id % 3 <> 0"), str(tmp_path), buckets=99)
    asked = spark.createDataFrame(ASKED, "query_id long, query string")
    got = {(r["query_id"], r["id"]): (r["rank"], round(r["score"], 6)) for r in text_index.bm25_search(asked, index, 4).collect()}
    want = brute_bm25(texts(), ASKED, 4)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    assert text_index.bm25_search(asked.where("query_id in (3, 4, 5)"), index, 4).count() == 0
    pairs = spark.createDataFrame([(2, 404, 0.5, 1), (2, 0, 0.4, 2), (2, 401, 0.3, 3), (5, 1, 0.9, 1), (5, 2, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    best = [(r["query_id"], r["chunk_id"], r["rank"]) for r in retrieval.rerank_bm25(pairs, asked, index, 3).orderBy("query_id", "rank").collect()]
    assert best[0] == (2, 404, 1) and best[2] == (2, 401, 3) and best[3:] == [(5, 1, 1), (5, 2, 2)]


def folders_read(df):
    """How many partitions' folders the scan of a DataFrame reads."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).selectedPartitions().partitionCount()


def test_index_reads_its_buckets_only(spark, tmp_path):
    index = text_index.add_to_index(spark.createDataFrame(texts(), "chunk_id long, text string"), str(tmp_path), buckets=32)
    rows = index.postings(spark.createDataFrame([("rare",)], "term string"))
    assert folders_read(rows) == 1 and rows.where("term = 'rare'").count() == 2


@pytest.mark.parametrize("most", [500_000, 0])
def test_texts_with(spark, monkeypatch, most):
    monkeypatch.setattr(text_index, "BROADCAST_ROWS", most)
    monkeypatch.setattr(text_index, "GRAM_BYTES", 300)
    rows = [*texts(), (403, "twice 日本x"), (500, "ab\0c"), (501, "é")]
    patterns = [(1, "the"), (2, "e"), (3, "é"), (4, "日本"), (5, "w1 w"), (6, ""), (7, None), (8, "rare the"), (9, "zz"), (10, "w1"), (11, "h"), (12, "Straße w"), (13, "the " * 500), (14, "\0"), (15, "nowhere at all")]
    got = text_index.texts_with(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(patterns, "item_id long, text string"))
    want = {(p, i) for p, s in patterns if s for i, t in rows if t and s in t and i is not None}
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_keywords(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_CHARS", most)
    monkeypatch.setattr(keywords, "GATHERED", 20)
    words = ["The", "w1", "W1", "STRASSE", "straße", "e w", "日", "nothing", "", None, "h"]
    df = spark.createDataFrame(texts(), "chunk_id long, content string").repartition(3)
    got = keywords.keyword_hits(df, spark.createDataFrame([(w,) for w in words], "keyword string"))
    want = {(w, i) for w in words if w for i, t in texts() if t and i is not None and w.lower() in t.lower()}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_keyword_coverage(spark, monkeypatch):
    monkeypatch.setattr(keywords, "GATHERED", 2)
    rows = spark.createDataFrame([("a", "FIRE in the house"), ("a", None), ("b", None), ("c", "water"), (None, "fire"), ("d", "")], "workspace_id string, content string").repartition(3)
    kinds = {"F": ["fire", "flame"], "W": ["water", "fire"], "none": [], "all": [""]}
    got = {(r["workspace_id"], r["sensor_type"]): r["covered"] for r in report.keyword_coverage(rows, kinds).collect()}
    yes = {("a", "F"), ("a", "W"), ("a", "all"), ("c", "W"), ("c", "all"), (None, "F"), (None, "W"), (None, "all"), ("d", "all")}
    assert got == {(w, t): (w, t) in yes for w in ("a", "b", "c", "d", None) for t in kinds}


# ---- vectors ----


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0]), (8, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    asked = v.withColumnRenamed("vec_id", "query_id")
    for search in (retrieval.knn_exact, lambda *a, **b: retrieval.knn_approx(*a, nlist=2, nprobe=2, **b)):
        got = {(r["query_id"], r["vec_id"], r["rank"]) for r in search(asked, v, 3).collect()}
        assert got == {(1, 1, 1), (1, 7, 2), (1, 8, 3), (7, 7, 1), (7, 1, 2), (7, 8, 3), (8, 1, 1), (8, 7, 2), (8, 8, 3)}
    none = v.where("vec_id in (2, 3)")
    assert retrieval.knn_exact(asked, none, 3).count() == 0 and retrieval.knn_approx(asked, none, 3).count() == 0
    assert retrieval.knn_exact(none.withColumnRenamed("vec_id", "query_id"), v, 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_stored_vector_index(spark, tmp_path, metric):
    """Built once, added to, searched with queries that the index has never seen; only probed cells' folders are read."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24)) * 2
    make = lambda n: [(i, (centres[i % 30] + rng.normal(size=24)).tolist()) for i in range(n)]
    rows, asked = make(3000), make(200)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    index = vector_search.build_vector_index(v.where("vec_id < 2500"), str(tmp_path / "ix"), metric=metric, k=10)
    vector_search.add_vectors(index, v.where("vec_id >= 2500"))
    index = vector_search.VectorIndex(spark, str(tmp_path / "ix"))
    assert index.nprobe < len(index.centres) and index.cells().count() == 3000
    found = {(r["query_id"], r["vec_id"]) for r in vector_search.search_vectors(q, index, 10).collect()}
    exact = {(r["query_id"], r["vec_id"]) for r in vector_search.knn_exact(q, v, 10, metric).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert folders_read(index.cells([0, 3])) == 2 and 2 < folders_read(index.cells()) <= len(index.centres)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        vector_search.build_vector_index(v, str(tmp_path / "ix"))


def test_embedding_failures(spark, tmp_path):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(i, "bad" if i % 7 == 3 else f"text {i}") for i in range(50)] + [(60, None)], "id long, text string").coalesce(2)
    got = {r["id"]: (r["embedding"], r["why"]) for r in embedding.embed_batches(rows, "text", model, "", 10, dim=2, error="why").collect()}
    assert all((got[i][0] == [0.0, 0.0] and got[i][1] == "RuntimeError: no") == (i % 7 == 3) for i in range(50)) and got[60] == ([0.0, 1.0], None)
    with pytest.raises(Exception, match="RuntimeError"):
        embedding.embed_batches(rows, "text", model).collect()
    cache = str(tmp_path / "cache")
    count = lambda: collections.Counter(r["how"] for r in embedding.embed_cached(rows, "text", cache, 2, model, "").collect())
    assert count() == {"new": 44, "failed": 7} and count() == {"reused": 44, "failed": 7}


# ---- tables ----


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    docs = spark.createDataFrame([(i,) for i in range(1000)], "id long").select("id", (F.col("id") % 3).cast("int").alias("status"))
    parts = spark.range(3000).select(F.col("id").alias("part"), (F.col("id") % 1000).alias("doc"))
    store.create("docs", docs, "id", 128)
    store.create("parts", parts, "doc", 16)
    before = store.state()[1]
    done = store.upsert("docs", spark.createDataFrame([(5, 7), (5, 9), (2000, 1), (None, 4)], docs.schema), "id")
    after = store.state()[1]
    assert 0 < len(done) <= 3 and after["parts"] == before["parts"]
    assert all(after["docs"]["files"][b] == f for b, f in before["docs"]["files"].items() if int(b) not in done)
    assert {r["status"] for r in store.read("docs", spark.createDataFrame([(5,), (2000,)], "x long")).collect()} == {9, 1} and store.read("docs").count() == 1002
    store.upsert("docs", spark.createDataFrame([(5, 8), (6, 99)], docs.schema), "id", "status", newer=True)
    assert [r["status"] for r in store.read("docs").where("id in (5, 6)").orderBy("id").collect()] == [9, 99]
    old = store.read("docs")
    unknown = store.delete_owned(spark.createDataFrame([(6,), (7,), (7,), (5000,)], "id long"), "docs")
    assert [r["id"] for r in unknown.collect()] == [5000] and store.read("docs").count() == 1000 and store.read("parts").count() == 3000 - 6
    assert old.count() == 1002  # readers of the state before are not disturbed
    store.replace_owned("parts", spark.createDataFrame([(9000, 8), (9001, 8)], parts.schema))
    assert sorted(r["part"] for r in store.read("parts", spark.createDataFrame([(8,)], "x long")).collect()) == [9000, 9001]
    assert store.vacuum() and store.read("docs").count() == 1000 and store.read("parts").count() == 2993 and not store.vacuum()


def test_store_writers(spark, tmp_path):
    """Of two writers that started from one state, one fails; one that dies leaves what was there."""
    store = Store(spark, str(tmp_path))
    store.create("docs", spark.range(10), "id", 4)

    def slow(old):
        Store(spark, str(tmp_path)).upsert("docs", spark.range(10, 12), "id")
        return old.limit(0)

    with pytest.raises(ValueError, match="another writer"):
        store.change({"docs": (spark.range(10), slow)})
    assert store.read("docs").count() == 12

    def dies(old):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        store.change({"docs": (spark.range(10), dies)})
    assert store.read("docs").count() == 12 and len(tables.published(spark, f"{tmp_path}/manifest", 9)[0]) == 2


def test_json_buckets(spark, tmp_path):
    rows = spark.range(100_000).select(F.col("id").alias("document_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    S.write_json(rows, f"{tmp_path}/j")
    assert len([p for p in (tmp_path / "j").iterdir() if p.is_dir()]) <= 256
    one = S.read_json(spark, f"{tmp_path}/j", rows.schema, [77])
    assert [tuple(r) for r in one.collect()] == [(77, "text 77")] and folders_read(one) == 1
    assert S.read_json(spark, f"{tmp_path}/j", rows.schema).count() == 100_000
