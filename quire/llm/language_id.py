"""Language identification: a linear-chain conditional random field labels the words of a text, also of code-switched ones.

Features of a word are its affixes (up to three letters), inner n-grams of two and three letters, and its place in a lexicon
of the training words; transitions between languages are learned with them. Forward-backward gives each word's distribution
over the languages, and a document gets the language with the largest mean."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import scratch, staged
from quire.llm.words import REMEMBERED

#: Runs of letters; numbers that \w takes in (superscripts, fractions, numerals) are left out.
LETTERS = re.compile(r"[^\W\d_²³¹¼-¾\u2150-\u2182\u2185-\u218b\u2460-\u249b]+").findall
#: The sample to fit on: per language so many distinct texts, those with the smallest hashes; of longer ones a passage of so
#: many code points.
SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
#: Languages that are learned at most, and the groups in which the hashes of one are ranked first.
MOST_LABELS, SPREAD = 256, 64
#: Buckets of hashed n-grams, words in the lexicon, words in a sequence.
BUCKETS, LEXICON, SEQUENCE = 1 << 16, 20_000, 64
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def ngram_features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, buckets) for n-grams of 2, 3 and 4 signs over ^word$; of those with 4 only the ones at either end."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place, size = np.arange(len(codes)) - starts[owner], sizes[owner]
    out = []
    for n in (2, 3, 4):
        at = np.flatnonzero(place + n <= size)
        if n == 4:
            at = at[(place[at] == 0) | (place[at] + n == size[at])]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * _ODD[k]
            h ^= h >> np.uint64(29)
        out.append((owner[at], ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)))
    return out


class Crf:
    """Weights: n-gram buckets and lexicon words by language, and transitions between languages."""

    def __init__(self, languages: list[str], lexicon: list[str]):
        self.languages, self.words, self.lexicon = languages, lexicon, {w: BUCKETS + k for k, w in enumerate(lexicon)}
        self.weights = np.zeros((BUCKETS + len(lexicon), len(languages)), np.float32)
        self.transitions = np.zeros((len(languages), len(languages)))

    def features(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [(k, v) for k, v in enumerate(map(self.lexicon.get, words)) if v is not None]
        return [*ngram_features(words), tuple(np.array(found, np.int64).reshape(-1, 2).T)]

    def scores(self, features: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        out = np.zeros((n, len(self.languages)))
        for owner, feature in features:
            w = self.weights[feature]
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(owner, w[:, k], n)
        return out


def forward_backward(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Distribution over the labels at each place of each sequence; scores: sequences x places x labels (logs), mask: places in
    use, at the front. With pairs, also the expected number of each transition."""
    move = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    n, steps, labels = scores.shape
    ahead = np.empty_like(emit)
    ahead[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (ahead[:, t - 1] @ move) * emit[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    back = np.full((n, labels), 1 / labels)
    out, moves = ahead.copy(), np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        on = mask[:, t + 1]
        rest = emit[:, t + 1] * back
        if pairs:
            both = ahead[:, t][on, :, None] * move * rest[on, None, :]
            moves += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = rest @ move.T
        back = np.where(on[:, None], b / b.sum(axis=1, keepdims=True), 1 / labels)
        p = out[:, t] * back
        out[:, t] = p / p.sum(axis=1, keepdims=True)
    return (out, moves) if pairs else out


def sequences(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of so many words each, cut into sequences: word numbers (sequences x SEQUENCE) and the mask."""
    starts, lengths, first = [], [], 0
    for size in sizes:
        at = np.arange(0, size, SEQUENCE)
        starts.append(first + at)
        lengths.append(np.minimum(SEQUENCE, size - at))
        first += size
    start, length = np.concatenate(starts), np.concatenate(lengths)
    steps = np.arange(SEQUENCE)
    mask = steps < length[:, None]
    return np.where(mask, start[:, None] + steps, 0), mask


def fit(texts: list[tuple[str, str]], passes: int = 3, seed: int = 7) -> Crf:
    """From (language, text): by stochastic gradient on the likelihood of sequences, a third of which switch the language
    midway, so that transitions are learned. The languages take turns."""
    languages = sorted({x for x, _ in texts})
    rng = np.random.default_rng(seed)
    parts: list[list[list[str]]] = [[] for _ in languages]
    count: Counter = Counter()
    for language, text in texts:
        words = [w.lower() for w in LETTERS(text)]
        count.update(words)
        parts[languages.index(language)] += [words[k : k + SEQUENCE] for k in range(0, len(words), SEQUENCE)]
    crf = Crf(languages, sorted(w for w, n in count.most_common(LEXICON) if n > 2))
    if len(languages) < 2:
        return crf
    number = {w: k for k, w in enumerate(count)}
    features = crf.features(list(number))
    owner, feature = (np.concatenate(x) for x in zip(*features, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, feature = owner[order], feature[order]
    begin = np.searchsorted(owner, np.arange(len(number) + 1))
    most = max(map(len, parts))
    squares, move_squares = np.full(crf.weights.shape, 1e-2, np.float32), np.full(crf.transitions.shape, 1.0)
    for _ in range(passes):
        todo = [(k, i) for k, p in enumerate(parts) if p for i in rng.integers(0, len(p), min(most, 2 * len(p)))]
        rng.shuffle(todo)
        for at in range(0, len(todo), 128):
            ids = np.zeros((len(todo[at : at + 128]), SEQUENCE), np.int64)
            labels, mask = np.zeros_like(ids), np.zeros(ids.shape, bool)
            for r, (k, i) in enumerate(todo[at : at + 128]):
                words = [(number[w], k) for w in parts[k][i]]
                if r % 3 == 0:
                    k2 = int(rng.integers(len(parts)))
                    if parts[k2]:
                        other, cut = parts[k2][rng.integers(len(parts[k2]))], int(rng.integers(1, SEQUENCE))
                        words = (words[:cut] + [(number[w], k2) for w in other])[:SEQUENCE]
                ids[r, : len(words)], labels[r, : len(words)], mask[r, : len(words)] = *zip(*words, strict=True), True
            used, inverse = np.unique(ids[mask], return_inverse=True)
            spans = [np.arange(begin[u], begin[u + 1]) for u in used]
            f, own = feature[np.concatenate(spans)], np.repeat(np.arange(len(used)), [len(x) for x in spans])
            scores = np.zeros((*ids.shape, len(languages)))
            scores[mask] = crf.scores([(own, f)], len(used))[inverse]
            p, moves = forward_backward(scores, mask, crf.transitions, pairs=True)
            gap = -p[mask]
            gap[np.arange(len(gap)), labels[mask]] += 1
            change = np.stack([np.bincount(inverse, gap[:, k], len(used))[own] for k in range(len(languages))], axis=1)
            hit, back = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(back, change[:, k], len(hit)) for k in range(len(languages))], axis=1) / 128
            squares[hit] += grad**2
            crf.weights[hit] += 0.1 * grad / np.sqrt(squares[hit])
            seen = np.zeros_like(moves)
            np.add.at(seen, (labels[:, :-1][mask[:, 1:]], labels[:, 1:][mask[:, 1:]]), 1)
            step = (seen - moves) / 128
            move_squares += step**2
            crf.transitions += 0.1 * step / np.sqrt(move_squares)
    return crf


def sample(labelled: DataFrame, per_language: int = SAMPLE_DOCS, most_labels: int = MOST_LABELS) -> list[tuple[str, str]]:
    """(language, text) of at most per_language distinct texts of every language, from labelled (lang, text). Of a text beyond
    SAMPLE_CHARS it is a passage that starts at a place its hash gives, less words that are cut. Of more than most_labels
    languages, those with the most distinct texts are learned (of equals, those that sort first): the field and what is
    broadcast stay bounded if the column holds anything. Only distinct hashes are ranked, in SPREAD groups a language and then
    the best of these; passages of the chosen alone reach the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    with scratch(labelled.sparkSession):
        hashes = staged(rows.select("lang", "h").distinct())
        labels = hashes.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).select("lang")
        best = hashes.join(F.broadcast(labels), "lang")
        for group in (["lang", F.pmod("h", F.lit(SPREAD))], ["lang"]):
            best = best.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("h"))).where(F.col("k") <= per_language).drop("k")
        begin = F.pmod("h", F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
        part = F.regexp_replace(F.substring("text", begin, F.lit(SAMPLE_CHARS)), r"^\S{0,100}\s|\s\S{0,100}$", "")
        passage = F.when(F.char_length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(part)
        found = rows.join(F.broadcast(best), ["lang", "h"]).groupBy("lang", "h").agg(F.min(passage).alias("text"))
        return sorted((r["lang"], r["text"]) for r in found.select("lang", "text").collect())


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict every row's language: id_col, held_out, lang_pred, score (mean probability of lang_pred over the words), n_words,
    n_switches (places where the most likely language changes inside a sequence).

    The field is fitted on a bounded sample (SAMPLE_DOCS texts of every language, of MOST_LABELS languages at most) of rows where held_out is not true and lang_col is not
    null; predictions see the text alone. Whole texts are labelled, in sequences of SEQUENCE words.

    A null text, or one without a letter, gives `und` with score 0; so does every text if nothing could be learned. Equal
    means: the language that sorts first. Repeated rows and null ids are predicted like others. An empty table gives no
    rows. Other columns are ignored."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    fitted = fit(sample(base.where("not held_out").select("lang", "text")))
    # Plain lists and arrays: broadcasts, unlike functions, are not pickled by value.
    shared = base.sparkSession.sparkContext.broadcast((fitted.languages, fitted.words, fitted.weights, fitted.transitions))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, lexicon, weights, transitions = shared.value
        crf = Crf(languages, lexicon)
        crf.weights, crf.transitions = weights, transitions
        labels = len(crf.languages)
        known: dict[str, int] = {}
        table = np.zeros((0, labels))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                if len(known) > REMEMBERED:
                    known, table = {}, table[:0]
                texts = [LETTERS(x.lower()) if x else [] for x in part.column("text").to_pylist()]
                sizes = [len(x) for x in texts]
                rows = [("und", 0.0, n, 0) for n in sizes]
                if labels and sum(sizes):
                    new = list(set().union(*texts) - known.keys())
                    if new:
                        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                        table = np.concatenate([table, crf.scores(crf.features(new), len(new))])
                    ids = np.fromiter((known[w] for x in texts for w in x), np.int64, sum(sizes))
                    at, mask = sequences(sizes)
                    p = forward_backward(table[ids[at]], mask, crf.transitions)
                    best = p.argmax(axis=2)
                    change = ((best[:, 1:] != best[:, :-1]) & mask[:, 1:]).sum(axis=1)
                    owner = np.repeat(np.arange(len(sizes)), [-(-n // SEQUENCE) for n in sizes])
                    sums = np.stack([np.bincount(owner, np.where(mask, p[:, :, j], 0).sum(axis=1), len(sizes)) for j in range(labels)], axis=1)
                    changes = np.bincount(owner, change, len(sizes)).astype(int)
                    for i, n in enumerate(sizes):
                        if n:
                            j = int(sums[i].argmax())
                            rows[i] = (crf.languages[j], min(1.0, float(sums[i, j] / n)), n, int(changes[i]))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    kind = dict(base.dtypes)["id"]
    out = base.drop("lang").mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double, n_words long, n_switches long")
    return out.withColumnRenamed("id", id_col)
