"""Hand-written cases and properties of the operators that SQL does not cover."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.functions import geo as G
from quire.functions import text as T
from quire.operators import catalog, chunking, layout, retrieval, tables, vector_search
from quire.sources import files as S
from quire.sources import staging
from quire.streaming import jobs

B = "doc long, page int, block int, text string, type string, y_top double, y_bottom double, font_size double, ratio_to_body double, line_count int"


def block(page, n, text, kind="text", ratio=1.0):
    return (1, page, n, text, kind, 10.0 * n, 10.0 * n + 8, 10.0, ratio, 1)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_hebrew(spark):
    assert one(spark, "שלום עולם", T.is_hebrew_text) and not one(spark, "hello world ש abcdefgh", T.is_hebrew_text) and not one(spark, "", T.is_hebrew_text)
    assert one(spark, "םולש ןכל ךרד ףוס ץע", T.looks_reversed) and not one(spark, "שלום לכן דרך סוף עץ", T.looks_reversed)
    assert one(spark, "םולש  abcש 123", T.fix_reversed_words) == "שלום  abcש 123"
    assert one(spark, "a  b c", T.fix_word_order) == "c  b a" and one(spark, "  a b ", T.fix_word_order) == "  b a "
    rows = spark.createDataFrame([(1, 1, 0, "םולש ןכל ךרד ףוס ץע"), (1, 1, 1, "plain"), (2, 1, 0, "plain text")], "doc int, page int, line int, text string")
    got = {(r["doc"], r["line"]): r["text"] for r in layout.repair_rtl_lines(rows).collect()}
    assert got == {(1, 0): "עץ סוף דרך לכן שלום", (1, 1): "plain", (2, 0): "plain text"}


def test_header_rule(spark):
    rows = spark.createDataFrame([("text", 1.2, 2), ("text", 1.2, 3), ("table", 2.0, 1), ("header", 1.0, 9)], "k string, r double, n int")
    assert [x[0] for x in rows.select(T.is_header(F.col("k"), F.col("r"), F.col("n"))).collect()] == [True, False, False, True]


def test_merge_lines(spark):
    lines = spark.createDataFrame([(1, 1, 0, "Title", 0.0, 14.0, 14.0, 1.4), (1, 1, 1, "one", 20.0, 30.0, 10.0, 1.0), (1, 1, 2, "two.", 60.0, 70.0, 10.0, 1.0), (1, 1, 3, "three", 100.0, 110.0, 10.0, 1.0)],
        "doc int, page int, line int, text string, y_top double, y_bottom double, font_size double, ratio_to_body double")
    got = [(r["text"], r["type"], r["line_count"]) for r in layout.merge_lines(lines).orderBy("block").collect()]
    assert got == [("Title", "header", 1), ("one two.", "text", 2), ("three", "text", 1)]
    assert layout.merge_lines(lines, "v1").count() == 4


def test_cross_page(spark):
    rows = [block(1, 0, "starts here"), block(2, 0, " goes on"), block(3, 0, "ends. "), block(4, 0, "apart"), block(5, 0, "| a |", "table")]
    got = [(r["page"], r["text"], r["line_count"]) for r in chunking.repair_cross_page(spark.createDataFrame(rows, B)).orderBy("page", "block").collect()]
    assert got == [(1, "starts here goes on", 2), (3, "ends. ", 1), (4, "apart", 1), (5, "| a |", 1)]


def test_chunk_documents(spark):
    rows = [block(1, 0, "Head", ratio=1.5), block(1, 1, "body " * 400), block(1, 2, "| t |", "table"), block(2, 0, "Last", ratio=1.5)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, B)).collect()
    assert len({r["chunk_id"] for r in got}) == len(got) and max(len(r["text"]) for r in got) <= 1500
    by = {r["chunk_id"]: r for r in got}
    assert by["1_1_1_0"]["text"].startswith("Head\nbody") and by["1_1_1_0"]["header_block_ids"] == [0] and by["1_1_1_1"]["header_block_ids"] is None
    assert by["1_1_2_0"]["text"] == "| t |" and by["1_2_0_0"]["is_header"]


@settings(deadline=None, max_examples=300)
@given(st.text("ab .\n", max_size=900))
def test_split_is_lossless(text):
    parts = chunking.split_one(text, 120, 20)
    assert all(len(p) <= 120 for p in parts)
    at = 0  # every sign that isn't white space is in a chunk, in order
    body = text.strip()
    for p in parts:
        found = body.find(p, max(0, at - 40))
        assert found >= 0 and not body[at:found].strip()
        at = max(at, found + len(p))
    assert not body[at:].strip()


def as_before(text, size, overlap):
    """What the behaviour to match does, sign by sign."""
    text, out, start = text.strip(), [], 0
    while text and start < len(text):
        rest = text[start:]
        if len(rest) <= size:
            return [*out, rest]
        cut = size
        for mark in ("\n\n", "\n", " "):
            if rest[:size].rfind(mark) > 0:
                cut = rest[:size].rfind(mark) + len(mark)
                break
        out.append(rest[:cut].rstrip())
        step = cut
        if len(rest) - cut > size:
            low = max(0, cut - overlap)
            begins = None
            for i in range(low, cut):
                j = i + 1
                while rest[i] in ".!?" and j < cut and rest[j] in " \n":
                    j += 1
                if rest[i] in ".!?" and j < cut:
                    begins = j
                    break
            if begins is None:
                j = low
                while j < cut and rest[j] not in " \n":
                    j += 1
                while j < cut and rest[j] in " \n":
                    j += 1
                begins = j if j < cut else low
            step = begins if begins > 0 else cut
        start += max(step, size - overlap, 1)
    return out


@settings(deadline=None, max_examples=300)
@given(st.text("ab .!\n", max_size=900))
def test_split_with_steps(text):
    assert chunking.split_with_steps(text, 120, 20) == as_before(text, 120, 20)
    assert chunking.split_with_steps(text, 30, 29) == as_before(text, 30, 29)


def test_split_modes_differ():
    text = "x" * 250 + "\n" + "y" * 1600
    assert len(chunking.split_with_steps(text, 1500, 150)[0]) == 250 and "".join(chunking.split_with_steps(text, 1500, 150)).count("y") < 1600
    assert "".join(chunking.split_one(text, 1500, 150)).count("y") >= 1600


def test_blank_paragraphs_do_not_count():
    part = "word " * 70
    assert chunking.paragraphs(f"{part}\n\n \n\n{part}\n\n\n\n{part}") == chunking.paragraphs(f"{part}\n\n{part}\n\n{part}")


@settings(deadline=None, max_examples=200)
@given(st.text("ab .\n", max_size=4000))
def test_paragraphs_end(text):
    assert all(len(x) > 20 for x in chunking.paragraphs(text)) or len(text) <= 800


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.knn_exact(asked, rows, 5).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert exact == {(q, int(i)) for q in range(0, 600, 20) for i in np.argsort(-(unit @ unit[q]), kind="stable")[:5]}
    near = {(r["query_id"], r["vec_id"]) for r in retrieval.knn_approx(asked, rows, 5, nlist=16, nprobe=12).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    assert retrieval.knn_exact(asked.limit(0), rows, 5).count() == 0
    monkeypatch.setattr(vector_search, "CELL_PART", 7)
    monkeypatch.setattr(vector_search, "AT_ONCE", 3)
    every = retrieval.knn_approx(asked, rows, 5, nlist=4, nprobe=4).collect()
    assert {(r["query_id"], r["vec_id"]) for r in every} == exact and len(every) == len(exact)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 8)
    assert {(r["query_id"], r["vec_id"]) for r in retrieval.knn_exact(asked, rows, 5).collect()} == exact


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_approximate_search_recall(spark, sf):
    """The registered query, with its own parameters, against the exact one."""
    exact, near = ({(r["query_id"], r["chunk_id"]) for r in entry.queries()[name](spark, f"/root/testdata/sf{sf}").collect()} for name in ("knn_exact", "knn_approx"))
    assert len(near & exact) >= 0.9 * len(exact)
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert retrieval.knn_approx(rows.limit(0).withColumnRenamed("vec_id", "query_id"), rows, 5).count() == 0


def test_rerank_keeps_order_without_scorer(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id long, chunk_id string, score double, rank int")
    assert [(r["chunk_id"], r["score"]) for r in retrieval.rerank(rows, 2).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.8)]


def test_upserts_repeat(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, status string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "document_id long, status string")
    once = tables.upsert_registry(old, new)
    assert sorted(map(tuple, tables.upsert_registry(once, new).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        tables.upsert_registry(old, new, mode="insert")


def test_repeated_keys_have_one_result(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, status string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "x"), (3, "x")], "document_id long, status string")
    assert sorted(map(tuple, tables.upsert_registry(old, new).collect())) == [(1, "a"), (2, "d"), (3, "x")]
    out, unknown = tables.set_status(old, new)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "d")] and [r["document_id"] for r in unknown.collect()] == [3]
    timed = spark.createDataFrame([(2, "later", 2), (2, "sooner", 1)], "document_id long, status string, at int")
    assert tables.last_of(timed, "document_id", "at").first()["status"] == "later"
    sensors = spark.createDataFrame([(1, 5)], "sensor_id long, linked_file_id long")
    assert [tuple(r) for r in tables.link_sensor(sensors, spark.createDataFrame([(1, 7), (1, 6)], sensors.schema)).collect()] == [(1, 7)]


def test_replaced_table(spark, tmp_path):
    """Readers see the version that was named last; a folder that no entry names is no version, and entries are not made twice."""
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        tables.read_table(spark, path)
    tables.replace_table(spark.range(3), path)
    before = tables.read_table(spark, path)
    tables.replace_table(spark.range(5), path)
    spark.range(9).write.parquet(f"{path}/v-dead")
    assert tables.read_table(spark, path).count() == 5 and before.count() == 3
    entries, number = tables.published(spark, f"{path}/manifest", 9)
    assert [n for n, _ in entries] == [0, 1] and number == 2
    with pytest.raises(ValueError):
        tables.publish(spark, f"{path}/manifest", 1, "v-other")
    for torn in ("", "v-torn"):  # a writer that made its entry in two steps died between them
        fs, entry = tables.file_system(spark, f"{path}/manifest/{number:09d}")
        out = fs.create(entry, False)
        out.write(torn.encode())
        out.close()
        number += 1
        assert tables.read_table(spark, path).count() == 5
    tables.replace_table(spark.range(7), path)
    assert tables.read_table(spark, path).count() == 7


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Far:
        conf = spark.conf
        sparkContext = type("C", (), {"applicationId": "x", "master": "spark://host:7077"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            staging.shared_folder(Far)


def test_scratch_deletes(spark):
    with staging.scratch(spark):
        gone = staging.staged(spark.range(3))
        kept = staging.staged(spark.range(4), keep=True)
        place = gone.inputFiles()[0]
        assert gone.count() == 3
    assert kept.count() == 4 and not staging.file_system(spark, place)[0].exists(staging.file_system(spark, place)[1])


def test_documents_with(spark):
    docs = spark.createDataFrame([(1, "so it is one two three four five six, and more"), (2, "x one  two three four five six,"), (3, None), (4, "tail-one two"), (5, "one two three four five seven")], "doc_id long, text string")
    passages = spark.createDataFrame([(10, "one two three four five six"), (11, "ne two th"), (12, "one two"), (13, "two"), (14, ""), (15, None)], "item_id long, text string")
    got = {tuple(r) for r in retrieval.documents_with(docs, passages).collect()}
    want = {(i, d) for i, p in [(r[0], r[1]) for r in passages.collect()] if p for d, t in [(r[0], r[1]) for r in docs.collect()] if t and p in t}
    assert got == want and len(want) > 6
    assert retrieval.documents_with(docs, passages.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"text")
    got = {r["file_name"]: r["reject_reason"] for r in S.validate_pdf(S.scan_raw_files(spark, f"{tmp_path}/*.pdf"), spark.createDataFrame([("a.pdf",), ("b.pdf",)], "file_name string")).collect()}
    assert got == {"a.pdf": None, "b.pdf": "empty or missing", "c.pdf": "not a PDF"}
    (tmp_path / "r.json").write_text(json.dumps({"d1": {"file_name": "f", "status": "pending", "created_at": "2024-01-02T03:04:05Z", "file_hash": "h"}}))
    r = S.scan_registry_json(spark, f"{tmp_path}/r.json").first()
    assert (r["document_id"], r["status"], r["created_at"].year) == ("d1", "pending", 2024)
    (tmp_path / "g.json").write_text(json.dumps([{"query": "q", "query_type": "in_context", "expected_doc_id": "d", "expected_page": 3}, {"id": "1", "question": "w", "expected_pages": [1, 2]}]))
    assert sorted((x["question"], x["expected_pages"]) for x in S.scan_golden(spark, f"{tmp_path}/g.json").collect()) == [("q", [3]), ("w", [1, 2])]
    page = {"file_name": "f", "pages": [{"page_num": 1, "stats": {"median_font_size": 1.0, "max_font_size": 2.0}, "blocks": [{"text": "t", "type": "text", "y_top": 0.0, "y_bottom": 1.0, "font_size": 1.0, "ratio_to_body": 1.0, "line_count": 1}]}]}
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "doc9.json").write_text(json.dumps(page))
    assert [(x["doc"], x["page"], x["text"]) for x in S.scan_ocr_json(spark, f"{tmp_path}/ocr/*.json").collect()] == [("doc9", 1, "t")]
    S.write_json(spark.createDataFrame([("x", 1)], "document_id string, n int"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    S.write_eval_csv(spark.createDataFrame([("q", [1, 2])], "q string, pages array<int>"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["pages"] == "[1,2]"


def test_geometry_too_deep(spark):
    def nested(n):
        return '{"type":"Point","coordinates":[1,2]}' if not n else f'{{"type":"GeometryCollection","geometries":[{nested(n - 1)}]}}'

    rows = spark.createDataFrame([(nested(8),)], "g string")
    assert rows.select(G.extract_positions(F.col("g")).alias("p")).first()["p"] == [[1.0, 2.0]]
    with pytest.raises(Exception, match="too deep"):
        spark.createDataFrame([(nested(9),)], "g string").select(G.extract_positions(F.col("g"))).collect()
    odd = ['{"type":"Point","bbox":[10,20,30,40],"coordinates":[1,2]}', '{"type":"Point","coordinates":[]}', '{"type":"Point"}', '{"type":"LineString","coordinates":[[1],[2,3],[null,4]]}', '{"type":"LineString","coordinates":[["a",4],[1,2]]}', "not JSON", None, '{"type":"Polygon","coordinates":[1,2]}']
    got = [r["p"] for r in spark.createDataFrame([(i, g) for i, g in enumerate(odd)], "i int, g string").select("i", G.extract_positions(F.col("g")).alias("p")).orderBy("i").collect()]
    assert got == [[[1.0, 2.0]], [], [], [[2.0, 3.0]], [], [], [], []]


def test_one_page_of_many_lines(spark):
    """Time in proportion to the lines of a page."""
    n = 100_000
    lines = spark.range(n).select(F.lit(1).alias("doc"), F.lit(1).alias("page"), F.col("id").cast("int").alias("line"), F.lit("word").alias("text"), (F.col("id") * 12.0).alias("y_top"), (F.col("id") * 12.0 + 10).alias("y_bottom"), F.lit(10.0).alias("font_size"), F.lit(1.0).alias("ratio_to_body"))
    began = time.time()
    got = layout.merge_lines(lines.withColumn("y_top", F.col("y_top") + F.floor(F.col("line") / 4) * 100).withColumn("y_bottom", F.col("y_top") + 10)).collect()
    assert len(got) == n // 4 and {r["line_count"] for r in got} == {4} and time.time() - began < 30
    blocks = lines.select("doc", "page", F.col("line").alias("block"), "text", F.lit("text").alias("type"), "y_top", "y_bottom", "font_size", "ratio_to_body", F.lit(3).alias("line_count"))
    assert chunking.aggregate_blocks(blocks, 40).count() == n // 10


def test_nested_geometry(spark):
    g = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":[[[3,4,9],[5.5,-6]]]}]}]}'
    rows = spark.createDataFrame([(g,), ('{"type":"Odd","coordinates":[1,2]}',), (json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [7, 8]}, "properties": {"name": "n"}}),)], "geojson string")
    assert sorted(map(str, [r["positions"] for r in S.scan_geojson(rows).collect()])) == sorted(["[[1.0, 2.0], [3.0, 4.0], [5.5, -6.0]]", "[]", "[[7.0, 8.0]]"])


def worked(spark, out):
    return spark.read.parquet(f"{out}/data").where("not failed")


def test_ingest_stream(spark, tmp_path):
    """A document that fails takes no other with it, and is worked on again with the next batch; copies count once."""
    place, out = tmp_path / "in", tmp_path / "out"
    place.mkdir()
    for name, text in [("a", "one"), ("b", "one"), ("c", "two"), ("d", "three"), ("e", "four"), ("f", "five")]:
        (place / f"{name}.txt").write_text(text)

    def run(bad, retries=1):
        def work(doc):
            yield doc["document_id"], doc["text"][:1]
            if doc["text"] == bad:
                raise OSError("unreadable")
            yield doc["document_id"], doc["text"]

        jobs.ingest_stream(jobs.arriving_files(spark, str(place)), str(out), str(tmp_path / "check"), jobs.each_document(work, "document_id string, part string"), retries).awaitTermination()
        states = spark.read.schema(jobs.STATES.format(kind="string")).parquet(f"{out}/states").collect()
        return sorted((spark_text[r["file_hash"]], r["status"], r["error"]) for r in states)

    import hashlib

    spark_text = {hashlib.sha256(t.encode()).hexdigest(): t for t in ("one", "two", "three", "four", "five")}
    fine = [(t, "indexed", None) for t in ("five", "four", "one", "three")]
    assert run("two") == sorted([*fine, ("two", "error", "OSError: unreadable")])
    assert sorted(r["part"] for r in worked(spark, out).collect() if len(r["part"]) > 1) == ["five", "four", "one", "three"]
    (place / "h.txt").write_text("three")  # indexed already
    assert run("none", 2) == sorted([*fine, ("two", "error", "OSError: unreadable"), ("two", "indexed", None)])
    assert worked(spark, out).where("part = 'two'").count() == 1 and worked(spark, out).where("part = 'three'").count() == 1


def test_ingest_stream_marks_nobody_when_the_work_itself_fails(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("document_id"), F.current_timestamp().alias("arrived"), F.col("id").cast("string").alias("text"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    broken = lambda docs: docs.select("file_hash", F.raise_error(F.lit("the storage is down")).cast("string").alias("error"))
    with pytest.raises(Exception, match="the storage is down"):
        jobs.ingest_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/check", broken).awaitTermination()
    assert not (tmp_path / "out" / "states").exists()
    jobs.ingest_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/check", jobs.each_document(lambda d: [(d["document_id"],)], "document_id long")).awaitTermination()
    assert worked(spark, f"{tmp_path}/out").count() == 20 and spark.read.parquet(f"{tmp_path}/out/states").where("status = 'indexed'").count() == 20


def test_ingest_stream_many_failures(spark, tmp_path):
    """A thousand of ten thousand fail, in one pass over them."""
    rows = spark.range(10_000).select(F.col("id").alias("document_id"), F.current_timestamp().alias("arrived"), F.col("id").cast("string").alias("text"))
    rows.write.parquet(f"{tmp_path}/in")

    def work(doc):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write("x")
        return [(1 // (doc["document_id"] % 10),)]

    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    jobs.ingest_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", jobs.each_document(work, "x int"), retries=1).awaitTermination()
    states = spark.read.parquet(f"{tmp_path}/out/states").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in states} == {"error": 1000, "indexed": 9000} and (tmp_path / "calls").stat().st_size == 10_000


def test_transitions(spark, tmp_path):
    """Events out of order, over three batches; what is later than the watermark waits."""
    import datetime

    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    rows = [(1, 1, at(1), "pending"), (1, 2, at(2), "ocr_completed"), (1, 3, at(3), "indexed"), (1, 4, at(4), "error"), (2, 5, at(1), "chunked"), (2, 6, at(9), "indexed")]
    kind = "document_id long, event_id long, ts timestamp, status string"
    for k, part in enumerate([[rows[3], rows[1], rows[5]], [rows[2], rows[4]], [rows[0]], [(3, 7, at(600), "pending")]]):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/e/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e/*")
    run = jobs.flag_transitions(stream, "2 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["event_id"]: r["legal"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_dedupe_new_ids(spark):
    incoming = spark.createDataFrame([("h1", None), ("h2", "mine"), ("h3", None)], "file_hash string, document_id string")
    registry = spark.createDataFrame([("h1", "old", 1), ("h1", "older", 0)], "file_hash string, document_id string, created_at int")
    got = {r["file_hash"]: (r["document_id"], r["known"]) for r in catalog.dedupe_by_hash(incoming, registry).collect()}
    assert got["h1"] == ("older", True) and got["h2"] == ("mine", False) and got["h3"][0]
    incoming = spark.createDataFrame([(1, "n", "first"), (2, "n", "second"), (3, "m", None), (4, "m", None)], "at int, file_hash string, document_id string")
    got = {r["at"]: (r["document_id"], r["known"]) for r in catalog.dedupe_by_hash(incoming, registry, "at").collect()}
    assert got[1] == ("first", False) and got[2] == ("first", True) and got[3][0] == got[4][0] and (got[3][1], got[4][1]) == (False, True)
    again = {r["at"]: r["document_id"] for r in catalog.dedupe_by_hash(incoming, registry, "at").collect()}
    assert again[3] == got[3][0]
