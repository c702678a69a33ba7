"""Fill-in-middle, centroid clustering and decontamination against brute force, with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import clustering, decontamination, fill_in_middle
from quire.llm.clustering import Bounds, cluster_vectors, drifted, squares
from quire.llm.decontamination import benchmark_hits
from quire.llm.fill_in_middle import BoundarySet, boundaries, restored
from tests.llm.test_operators import SCHEMA, odd_rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return collections.Counter(map(tuple, df.collect()))


# ---- 11: fill-in-middle ----


@pytest.mark.parametrize("kind, offsets", [
    ("array", range(0, 60_000, 17)), ("bitmap", [x for x in range(60_000) if x % 3]), ("runs", range(65_536)), ("runs", [*range(10, 900), *range(5_000, 65_000)]), ("array", [0])])
def test_boundary_set_selects(kind, offsets):
    s = BoundarySet(np.array(offsets))
    assert s.kinds == [kind] and len(s) == len(offsets)
    assert [s[k] for k in range(0, len(s), 7)] == list(offsets)[::7] and s[len(s) - 1] == offsets[-1]


def test_boundary_set_of_many_containers():
    rng = random.Random(2)
    offsets = sorted({rng.randrange(1 << 20) for _ in range(3_000)} | set(range(200_000, 290_000)) | set(range(400_000, 440_000, 2)))
    s = BoundarySet(np.array(offsets))
    assert {"array", "bitmap", "runs"} == set(s.kinds) and all(s[k] == offsets[k] for k in range(0, len(offsets), 11))
    with pytest.raises(IndexError):
        s[len(offsets)]
    assert len(BoundarySet(np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("text", ["", "a", "\n", "a\nb", "é\nüü\n\n日本\nx", "\n" * 70_000, "no newline at all 😀"])
def test_boundaries(text):
    ends = [m.end() for m in re.finditer("[^\n]*\n|[^\n]+", text)]
    s = boundaries(text)
    assert [s[k] for k in range(len(s))] == [0, *ends]
    assert len(boundaries(text, "char")) == len(text) + 1


def middle(i, text, rate, spm):
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return i, len(lines), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return i, len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (30, 100), (0, 50)])
def test_fill_in_middle(spark, odd, none, rate, spm):
    rows = odd.unionByName(spark.createDataFrame([(300 + k, t) for k, t in enumerate(["a<P>b\nc", "<S>", "<M", "P>\n<", "<<S\nS>>\n<P\n", "$1 \\E \n$2\n\r\n"])], "doc_id long, text string"), allowMissingColumns=True)
    got = fill_in_middle.fill_in_middle(rows, 7, rate, spm)
    assert pairs(got) == collections.Counter(middle(r["doc_id"], r["text"], rate, spm) for r in rows.collect())
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert pairs(back) == pairs(rows.select("doc_id", F.coalesce("text", F.lit(""))))
    assert fill_in_middle.fill_in_middle(none).count() == 0


def test_fill_in_middle_by_characters(spark):
    rows = spark.createDataFrame([(i, "añb😀c日" * (i % 4)) for i in range(40)], "key string, body string")
    got = fill_in_middle.fill_in_middle(rows, 3, marks=("[[a]]", "[[b]]", "[[c]]"), unit="char", id_col="key", text_col="body")
    assert {r["n"] for r in got.collect()} == {0, 6, 12, 18}
    assert pairs(got.select("key", restored(F.col("output"), F.col("form"), ("[[a]]", "[[b]]", "[[c]]")))) == pairs(rows)
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(rows, marks=marks, id_col="key", text_col="body")
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(rows, unit="page", id_col="key", text_col="body")


# ---- 12: centroid clustering ----


def brute_clusters(rows, k, rounds, dims, seed=1):
    """As plain loops over whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(min(max(64 * float(np.float32(x)), -(2.0**27)), 2.0**27))) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda n: (hashlib.sha256(f"{seed}:{'' if kept[n][0] is None else kept[n][0]}".encode()).hexdigest(), [float(np.float32(x)) for x in kept[n][1]]))
    centres = [list(whole[n]) for n in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((square(v, c), n) for n, c in enumerate(centres)) for v in whole]
    for _ in range(rounds):
        own = [n for _, n in assign()]
        for n in range(len(centres)):
            mine = [v for v, o in zip(whole, own, strict=True) if o == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = assign()
    inertia = collections.Counter()
    for d, n in last:
        inertia[n] += d
    return collections.Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True))


def odd_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + 0.4 * rng.normal(size=6)).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(40)] + [(450 + i, [0.25, -0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(9)]  # ties and copies
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [None] + [1.0] * 5), (504, [float("nan")] + [1.0] * 5), (505, [float("inf")] + [1.0] * 5), (506, [1.0] * 7)]
    return rows + [(507, [3e6] + [0.0] * 5), (508, [-3e38] + [0.0] * 5), (None, [0.1] * 6), (None, [0.2] * 6), (3, [0.3] * 6), (3, [0.3] * 6)]


@pytest.mark.parametrize("k, rounds", [(16, 3), (1, 2), (40, 6), (5, 0)])
def test_cluster_vectors(spark, k, rounds):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, n int, id string").repartition(4)
    assert pairs(cluster_vectors(df, k, rounds, dims=6)) == brute_clusters(rows, k, rounds, 6)


def test_cluster_few_or_no_vectors(spark):
    kind = "vec_id string, embedding array<double>"
    two = [("a", [1.0, 2.0]), ("b", [5.0, 6.0])]
    assert pairs(cluster_vectors(spark.createDataFrame(two, kind), 16, dims=2)) == brute_clusters(two, 16, 3, 2)
    none = cluster_vectors(spark.createDataFrame([("a", None)], kind), 16, dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-clustering.MOST, clustering.MOST, (50, 64))
    c = rng.integers(-clustering.MOST, clustering.MOST, (5, 64))
    assert squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, o, strict=True)) for o in c] for r in x]


def test_bounds_spare_most_vectors():
    """In well separated clusters only some gaps expire once the centroids have settled, and none that matters is missed."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-40, 40, (8, 16))
    x = (centres[rng.integers(0, 8, 4000)] + rng.integers(-6, 7, (4000, 16))).astype(np.int8)
    c, drift, bounds, scanned = centres + rng.integers(-3, 4, centres.shape), np.zeros(8), None, []
    for _ in range(6):
        if bounds is None:
            bounds = Bounds.new(x, c, drift)
        else:
            bounds = Bounds.unpacked(*bounds.packed())
            scanned.append(len(bounds.move(x, c, drift)[0]))
        want = squares(x, c).argmin(1)
        assert (bounds.assigned == want).all()
        new = np.array([x[want == k].sum(0, dtype=np.int64) // max(1, (want == k).sum()) for k in range(8)])
        drift, c = drifted(drift, c, new), new
    assert scanned[-1] < 0.05 * len(x)


# ---- 13: decontamination ----

CUT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall


def words(t):
    return CUT(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, window=10, rarest=2, slop=3):
    items = [("" if i is None else str(i), words(t)) for i, t in items]
    df = collections.Counter(w.lower() for _, t in docs for w in words(t))
    out = collections.Counter()
    for i, t in docs:
        own = words(t)
        low, hit, names, near = [w.lower() for w in own], set(), set(), set()
        for name, ws in items:
            n = min(window, len(ws))
            for j in range(len(ws) - n + 1 if ws else 0):
                for s in range(len(own) - n + 1):
                    if own[s : s + n] == ws[j : j + n]:
                        hit |= set(range(s, s + n))
                        names.add(name)
                rare = sorted((df[w.lower()], j + k) for k, w in enumerate(ws[j : j + n]))[:rarest]
                if rare[0][0]:
                    begins = [[p - o for p, w in enumerate(low) if w == ws[o].lower()] for _, o in rare]
                    if any(all(any(b <= x <= b + slop for x in xs) for xs in begins) for b in {x for xs in begins for x in xs}):
                        near.add(name)
        out[i, len(own), len(hit), len(names), tuple(sorted(names)), len(near - names)] += 1
    return out


def leaky_rows():
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ba", "ña", "Éo", "x", "q7", "日") for b in ("ra", "Ñu", "k", "la", "ss")] + ["the", "of"] * 8
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(rng.choice((3, 9, 10, 11, 25, 40))))) for k in range(30)]
    items += [(40, "the"), (41, ""), (42, None), (43, "..,"), (None, " ".join(some(14))), (45, items[3][1].upper()), (3, items[4][1]), (46, "the the the the the the the the the the the the"), (47, "unseen words of nothing")]
    docs = []
    for k in range(50):
        parts = some(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            ws = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(ws) + 1)
            piece = ws[a : a + rng.randrange(30)]
            if len(piece) > 5 and rng.random() < 0.4:
                piece.insert(4, "between")
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = piece
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts).replace("the", rng.choice(["the", "The", "THE"]))))
    whole = " ".join(some(5) + items[5][1].split() + ["the"] * 30)
    docs += [(100, None), (101, ""), (102, " .;"), (103, whole), (103, whole), (103, "..." + whole), (None, whole), (None, whole), (104, items[7][1]), (105, "ÑA ña Éo éo " * 300 + whole * 3)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, item_id string, k1 int, pos int").repartition(3)
    return d, spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("window, rarest, slop, most", [(10, 2, 3, None), (10, 2, 3, 0), (3, 1, 2, None), (6, 3, 4, None), (1, 2, 0, None)])
def test_benchmark_hits(spark, monkeypatch, window, rarest, slop, most):
    docs, items = leaky_rows()
    if most is not None:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    got = benchmark_hits(*frames(spark, docs, items), window=window, rarest=rarest, slop=slop)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["n_near"]) for r in got.collect())
    assert got == brute_hits(docs, items, window, rarest, slop)
    assert sum(r[2] > 0 for r in got) > 5 and (window < 5 or sum(r[5] > 0 for r in got) > 0)


def test_benchmark_hits_of_nothing(spark):
    docs, items = leaky_rows()
    assert benchmark_hits(*frames(spark, [(1, None)], items)).drop("items").collect()[0][1:] == (0, 0, 0, 0)
    assert benchmark_hits(*frames(spark, docs, [(1, ""), (2, None)])).where("n_hit > 0 or n_near > 0 or size(items) > 0").count() == 0
    empty = frames(spark, docs, items)[0].limit(0)
    assert benchmark_hits(empty, frames(spark, docs, items)[1]).count() == 0
    with pytest.raises(ValueError):
        benchmark_hits(*frames(spark, docs, items), rarest=4, slop=20)
