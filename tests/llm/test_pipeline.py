"""The pipeline's stages, each on its own input, and all of them against a brute-force version of their decisions."""

import collections

import pytest

import corpus_pipeline
from tests.llm.test_operators import SF, WORDS, brute_duplicates, brute_surface, check_packing, low

ODD = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (None, "no id either", None, None, 12), (3, "twice the same row", "de", "t", 18), (3, "twice the same row", "de", "t", 18)]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        out.append(docs.toPandas())
    return out


def test_stages_keep_the_columns(steps):
    assert all(list(x.columns) == corpus_pipeline.COLUMNS for x in steps[:-1])


def test_quality_stage(steps):
    before, after = steps[0], steps[1]
    failed = {i for i, t in zip(before.doc_id, before.text, strict=True) if brute_surface(t)[-1]}
    assert not failed & set(after.doc_id) and set(after.doc_id) <= set(before.doc_id) and len(after) > 0.5 * (len(before) - len(failed))


def test_line_stage(steps):
    before, after = steps[1], steps[2].set_index("doc_id")
    seen = collections.Counter()
    for t in set(before.text):
        seen.update({low(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")} - {""})
    assert set(after.index) == set(before.doc_id)
    for i, t in zip(before.doc_id, before.text, strict=True):
        want = "\n".join(x for x in t.split("\n") if seen[low(x.strip(" \t\n\x0b\x0c\r"))] < 10)
        assert after.loc[i].text == want and after.loc[i].n_chars == len(want)


def test_duplicate_stage(steps):
    want = {i for i, first, *_ in brute_duplicates(list(zip(steps[2].doc_id, steps[2].text, strict=True))) if i == first}
    assert set(steps[3].doc_id) == want and len(steps[3]) == len(want)


def test_mixing_and_packing_stages(steps):
    assert set(steps[4].doc_id) <= set(steps[3].doc_id)
    share = sum(len(WORDS(t)) for t in steps[4].text) / sum(len(WORDS(t)) for t in steps[3].text)
    assert 0.75 < share <= 1
    rows = list(zip(steps[4].doc_id, steps[4].text, strict=True))
    used, least = check_packing(rows, [r for _, r in steps[5].iterrows()])
    assert used <= 1.03 * least + 1


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = corpus_pipeline.staged(stage(spark, docs, SF))
        if name == "n-gram jaccard join" and rows:
            assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None", "None"]
        docs = out
    assert corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).count() == 0


def test_mixing_learns_from_all_rows(spark, monkeypatch):
    """The topics of the mixing stage are fitted to every row with words, copies and repeated ids included."""
    from quire.llm import mixing

    seen, fit = [], mixing.fit_topics
    monkeypatch.setattr(mixing, "fit_topics", lambda bags, *a: seen.append(bags.count() if hasattr(bags, "dtypes") else len(bags)) or fit(bags, *a))
    rows = [(i % 2000, f"w{i} v{i % 7} copy" if i % 50 else "one text", "en", "s", 9) for i in range(2300)] + ODD
    corpus_pipeline.mixed(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert seen == [2304]


def test_workers_get_each_text_once_and_few_at_a_time(spark, monkeypatch, tmp_path):
    """No stage sends a text to a Python worker, or gets it back, more than once in a pass, nor more than some MiB of texts in a batch."""
    rows = [(i, " ".join(f"w{i * 7 + k}" for k in range(900)), "en", "s", 0) for i in range(1500)]
    docs = corpus_pipeline.staged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1))
    texts = sum(len(r[1]) for r in rows)
    plain = type(docs).mapInArrow

    def watched(df, f, schema, *more):
        note, asked = str(tmp_path / f"{len(list(tmp_path.iterdir()))}"), "text" in df.columns
        open(note, "w").close()

        def noted(batches, way):
            for b in batches:
                if asked:
                    with open(note, "a") as out:
                        out.write(f"{way} {b.nbytes}\n")
                yield b

        return plain(df, lambda batches: noted(f(noted(batches, "to")), "from"), schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    for _, stage in corpus_pipeline.STAGES:
        corpus_pipeline.staged(stage(spark, docs, SF))
    passes = [[line.split() for line in x.read_text().splitlines()] for x in tmp_path.iterdir()]
    moved = [[int(n) for way, n in x if way == one] for x in passes for one in ("to", "from") if x]
    assert len(moved) >= 10 and max(map(max, moved)) < 8 << 20 and all(sum(x) < 1.8 * texts for x in moved)


def test_workers_remember_few_words():
    """What a worker remembers of its words is dropped at 100,000 of them, and then gives the same."""
    import public_tokenizers

    from quire.llm.packing import Encoder
    from quire.llm.words import WordIds

    words, ids, encoder = [f"w{k}" for k in range(120_000)], WordIds(), Encoder(public_tokenizers.path("word_bpe_49k.json"))
    first = ids.hashes_of(ids.of(words[:9])).tolist()
    ids.of(words)
    ids.fresh()
    assert not ids and ids.hashes_of(ids.of(words[:9])).tolist() == first
    letters = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(120_000)]
    first = encoder.encode([" ".join(letters[:9])])
    encoder.encode([" ".join(letters)])
    assert encoder.encode([" ".join(letters[:9])]) == first and len(encoder.known) == 9


def test_rows_decide_for_themselves(spark):
    """Ids that are repeated over unrelated texts, or missing, lose no text and save none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r["text"] for r in corpus_pipeline.quality(spark, docs, SF).limit(40).collect()]
    junk = "zz %% " * 80
    rows = [(5, good[0]), (5, good[1]), (5, junk), (None, good[2]), (None, good[3]), (None, junk), (None, good[2]), (6, good[4]), (6, good[4])]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, table, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [x for x in rows if x[1] != junk]))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, table.where(f"text != '{junk}'"), SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, set(rows) - {(5, junk), (None, junk)}))
    mixed = corpus_pipeline.mixed(spark, table, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS and {(r["doc_id"], r["text"]) for r in mixed.collect()} <= set(rows)


def test_run_is_its_stages(spark, steps):
    """run() gives what the stages give one after the other, and deletes what they wrote between."""
    place = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(place, got)) == sorted(place(r) for _, r in steps[5].iterrows())
