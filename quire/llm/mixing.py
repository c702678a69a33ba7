"""Mixing sources to target weights: iterative proportional fitting (raking) of token weights to marginals of several columns,
then sampling of documents by the calibrated probabilities. Topics, where a table has none, are those of a multinomial mixture
over hashed words, learned from all rows and assigned to every row."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, scratch, staged

#: Cells (combinations of the columns' values that occur) that are raked on the driver; more are raked by Spark, the same way.
DRIVER_CELLS = 200_000
#: Most rounds of raking; it ends before when no marginal is off by more than CLOSE, or has come no closer in PATIENCE rounds, as
#: happens when the cells that exist can't meet all marginals.
ROUNDS, PATIENCE, CLOSE = 1_000, 20, 1e-9
#: Topics, and buckets of hashed words.
TOPICS, TOPIC_BUCKETS = 8, 1 << 13
#: Bits that a bucket's count has in a bag, and the most they hold; entries of bags that a worker takes at a time.
COUNT_BITS = 19
MOST_COUNTED, OPENED = (1 << COUNT_BITS) - 1, 1 << 15
#: Shares of topics are rounded to 1 / WHOLE, logs to multiples of GRAIN; topics have converged when a round moves so few words.
WHOLE, GRAIN, MOVED = 1 << 16, 2.0**-20, 1e-4
#: Texts that one pass proposes as starts, and how far apart starts are at least (1 less the cosine).
POOL, APART = 64, 1e-9
#: In a target given by shares, the share of all values that it does not name, which they have in proportion to their tokens.
OTHERS = "*"


# ---- topics ---------------------------------------------------------------------------------------------------------------


def bags_of(batch: list[list[bytes]]) -> list[bytes]:
    """Of each list of words its buckets, ascending, with how often each occurs: 32 bits of bucket and count (one that exceeds
    its bits is written in parts)."""
    sizes = np.fromiter(map(len, batch), np.int64, len(batch))
    at = np.fromiter(map(zlib.crc32, chain.from_iterable(batch)), np.uint32, sizes.sum()) % np.uint32(TOPIC_BUCKETS)
    found, n = np.unique(np.repeat(np.arange(len(batch)) * TOPIC_BUCKETS, sizes) + at, return_counts=True)
    if n.max(initial=0) > MOST_COUNTED:
        parts = -(-n // MOST_COUNTED)
        last = np.cumsum(parts) - 1
        rest = n - (parts - 1) * MOST_COUNTED
        found, n = np.repeat(found, parts), np.full(last[-1] + 1, MOST_COUNTED)
        n[last] = rest
    entries = ((found % TOPIC_BUCKETS).astype("<u4") << np.uint32(COUNT_BITS)) | n.astype("<u4")
    ends = np.searchsorted(found, np.arange(1, len(batch) + 1) * TOPIC_BUCKETS).tolist()
    data = entries.tobytes()
    return [data[4 * a : 4 * z] for a, z in zip([0, *ends], ends)]


def opened(bags: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets and counts of many bags in a row, and where each bag begins and the last one ends; some OPENED entries at a time."""
    first, size = 0, 0
    for k, bag in enumerate(bags, 1):
        size += len(bag) // 4
        if size > OPENED or k == len(bags):
            part = bags[first:k]
            entries = np.frombuffer(b"".join(part), "<u4")
            yield entries >> np.uint32(COUNT_BITS), (entries & np.uint32(MOST_COUNTED)).astype(np.float64), np.cumsum([0, *(len(x) // 4 for x in part)])
            first, size = k, 0


def summed(table: np.ndarray, bucket: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each bag, the sum of its buckets' rows of table by weight."""
    rows, at = table.take(bucket, axis=0), at.tolist()
    return np.array([weight[a:z] @ rows[a:z] for a, z in zip(at, at[1:])]).reshape(len(at) - 1, table.shape[1])


def likeness(starts: np.ndarray, bucket: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosines (bags x starts) of the roots of counts."""
    return summed(starts, bucket, np.sqrt(count), at) / np.sqrt(np.add.reduceat(count, at[:-1]))[:, None]


def shares(logs: np.ndarray, bucket: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What each topic has of each bag. logs are multiples of GRAIN, so that their sums are exact in any order."""
    score = summed(logs[:-1], bucket, count, at) + logs[-1]
    share = np.exp(score - score.max(axis=1, keepdims=True))
    return share / share.sum(axis=1, keepdims=True)


def keys_of(clock: np.ndarray, starts: np.ndarray, bucket: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each bag's clock over the square of 1 less the cosine to the nearest start; infinite for one that is like a start."""
    far = 1 - likeness(starts, bucket, count, at).max(axis=1) if starts.shape[1] else np.ones(len(clock))
    return np.divide(clock, far**2, out=np.full(len(clock), np.inf), where=far > APART)


def least_keys(bags: DataFrame, starts: np.ndarray) -> list[tuple[float, bytes]]:
    """(clock, bag) of the POOL least keys of all bags, ascending. Clocks are exponential draws by the bag's hash, so that copies have
    one and partitions don't matter."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[float, float, bytes]] = []
        for b in batches:
            column, hashes, first = b.column("bag").to_pylist(), b.column("h").to_numpy().view(np.uint64), 0
            for part in opened(column):
                last = first + len(part[2]) - 1
                clock = -np.log(((hashes[first:last] >> np.uint64(11)) + 0.5) / (1 << 53))
                key = keys_of(clock, starts, *part)
                some = np.flatnonzero(key < (best[-1][0] if len(best) == POOL else np.inf))
                best = sorted({*best, *((float(key[k]), float(clock[k]), column[first + k]) for k in some.tolist())})[:POOL]
                first = last
        for key, clock, bag in best:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([clock]), pa.array([bag])], names=["key", "clock", "bag"])

    found = bags.select("bag", F.xxhash64("bag").alias("h")).mapInArrow(keys, "key double, clock double, bag binary")
    return [(r["clock"], bytes(r["bag"])) for r in found.distinct().orderBy("key", "bag").limit(POOL).collect()]


def starts_of(bags: DataFrame, topics: int) -> np.ndarray:
    """Starts (buckets x topics, or fewer if there are fewer different texts): in turn, of all texts, that with the least key. A
    start only raises keys; so while the least key of a pool is no more than its greatest was when it was taken, no text
    outside is before it, and a new pass over all bags is only made beyond that."""
    starts, pool, bound = np.zeros((TOPIC_BUCKETS, 0)), [], 0.0
    while starts.shape[1] < topics:
        keys = [float(keys_of(np.array([clock]), starts, *next(opened([bag])))[0]) for clock, bag in pool]
        if not pool or min(keys) > bound:
            pool = least_keys(bags, starts)
            keys = [float(keys_of(np.array([clock]), starts, *next(opened([bag])))[0]) for clock, bag in pool]
            bound = max(keys) if len(pool) == POOL else np.inf
        if not pool or min(keys) == np.inf:
            break
        bucket, count, _ = next(opened([pool[int(np.argmin(keys))][1]]))
        starts = np.column_stack([starts, np.sqrt(np.bincount(bucket, count, TOPIC_BUCKETS) / count.sum())])
    return starts


def share_sums(bags: DataFrame, table: np.ndarray, of: Callable) -> np.ndarray:
    """Words by bucket and topic, and in the last row texts by topic, where of(table, ...) gives each bag's shares. Shares are rounded
    to 1 / WHOLE and summed as whole numbers: exact, whatever the partitions. Only sums reach the driver."""
    topics = table.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = np.zeros(topics * TOPIC_BUCKETS), np.zeros(topics)
        for b in batches:
            for bucket, count, at in opened(b.column("bag").to_pylist()):
                share = np.rint(of(table, bucket, count, at) * WHOLE)
                texts += share.sum(axis=0)
                each, sizes, main = np.arange(len(share)), np.diff(at), share.argmax(axis=1)
                sums += np.bincount(np.repeat(main * TOPIC_BUCKETS, sizes) + bucket, count * np.repeat(share[each, main], sizes), len(sums))
                share[each, main] = 0
                bag, topic = np.nonzero(share)  # few bags have more than one topic
                sizes = sizes[bag]
                place = np.repeat(at[bag] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                sums += np.bincount(np.repeat(topic * TOPIC_BUCKETS, sizes) + bucket[place], count[place] * np.repeat(share[bag, topic], sizes), len(sums))
        found = np.concatenate([sums.reshape(topics, -1), texts[:, None]], axis=1).astype(np.int64)
        rows = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(x[rows]) for x in found)], names=["bucket", *names])

    names = [f"t{k}" for k in range(topics)]
    got = bags.select("bag").mapInArrow(add, ", ".join(f"{c} long" for c in ["bucket", *names])).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((TOPIC_BUCKETS + 1, topics), np.int64)
    out[got.column("bucket").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names], axis=1)
    return out


def fit_topics(bags: DataFrame, topics: int = TOPICS, rounds: int = 30) -> np.ndarray | None:
    """Log probabilities (buckets x topics, the last row: of the topics themselves) of a multinomial mixture, by expectation
    and maximisation over all bags, each round one pass; it ends before when a round moves no more than MOVED of all words
    to another topic. The larger topic comes first. None without bags."""
    starts = starts_of(bags, topics)
    if not starts.shape[1]:
        return None
    sums, before = share_sums(bags, starts, lambda *x: np.eye(starts.shape[1])[likeness(*x).argmax(axis=1)]), None
    for _ in range(rounds):
        words, texts = sums[:-1] / WHOLE + 0.05, sums[-1] / WHOLE
        logs = np.concatenate([np.log(words / words.sum(axis=0)), np.log((texts + 1) / (texts.sum() + len(texts)))[None, :]])
        logs = np.rint(logs / GRAIN) * GRAIN
        if before is not None and np.abs(sums - before)[:-1].sum() <= 2 * MOVED * sums[:-1].sum():
            break
        before, sums = sums, share_sums(bags, logs, shares)
    return logs[:, np.argsort(-sums[-1], kind="stable")]


def measured(docs: DataFrame, learn: bool, with_text: bool = False) -> DataFrame:
    """docs (text, ...) with n_tokens (words) and topic, in place of text unless that is asked for; topics are learned from all
    texts, or null. A text without words has topic "none". Texts are read once, and their bags staged."""
    kept = [c for c in docs.columns if c != "text" or with_text]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, bags, some, held = [], [], [], 0
            for x in b.column("text").cast(pa.binary()):
                words = (x.as_py() or b"").split()  # ASCII white space parts bytes as it parts words
                sizes.append(len(words))
                if learn:
                    some.append(words)
                    held += len(words)
                    if held > OPENED:
                        bags += bags_of(some)
                        some, held = [], 0
            bags += bags_of(some) if some else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary()) if learn else pa.nulls(len(sizes), pa.binary())], names=[*kept, "n_tokens", "bag"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in kept)
    rows = staged(docs.mapInArrow(measure, f"{schema}, n_tokens long, bag binary"))
    logs = fit_topics(rows.where("n_tokens > 0")) if learn else None

    @F.arrow_udf("string")
    def topic_of(bag: pa.Array) -> pa.Array:
        out = []
        for bucket, count, at in opened(bag.to_pylist()):
            best = (summed(logs[:-1], bucket, count, at) + logs[-1]).argmax(axis=1).tolist()
            out += [f"t{k}" if n else "none" for k, n in zip(best, np.diff(at).tolist(), strict=True)]
        return pa.array(out, pa.string())

    none = F.lit("none" if learn else None).cast("string")
    return rows.select(*kept, "n_tokens", (none if logs is None else topic_of("bag")).alias("topic"))


# ---- targets and raking ---------------------------------------------------------------------------------------------------


Target = float | dict[str, float] | tuple[str, float]


def target_of(cells: DataFrame, column: str, targets: dict[str, Target]) -> DataFrame:
    """value, target. A power: the values' own shares of tokens raised to it, so that one below 1 lifts the small values. Shares:
    as given; what OTHERS has goes to all other values in proportion to their tokens. A column and a power: the power is
    applied within each value of that column, which has its own target; so topics of one language can't ask for more than it."""
    target = targets[column]
    if isinstance(target, tuple):
        other, power = target
        pairs = cells.groupBy(F.col(other).alias("of"), F.col(column).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(power))).alias("part"))
        above = target_of(cells, other, targets).select(F.col("value").alias("of"), F.col("target").alias("have"))
        sums = pairs.groupBy("of").agg(F.sum("part").alias("all")).where("all > 0").join(above, "of")
        return pairs.join(sums, "of").groupBy("value").agg(F.sum(F.col("have") * F.col("part") / F.col("all")).alias("target"))
    sums = cells.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    if not isinstance(target, dict):
        return sums.select("value", F.pow("tokens", F.lit(float(target))).alias("target"))
    named = cells.sparkSession.createDataFrame([(v, float(x)) for v, x in target.items() if v != OTHERS], "value string, share double")
    sums = sums.join(F.broadcast(named), "value", "left")  # as many rows as the caller wrote down
    rest = sums.where("share is null").agg(F.sum("tokens")).first()[0] or 0.0
    others = F.lit(float(target.get(OTHERS, 0.0))) * F.col("tokens") / F.lit(rest) if rest else F.lit(0.0)
    return sums.select("value", F.coalesce("share", others).alias("target"))


def settled(history: list[float]) -> bool:
    """Whether raking has met its marginals, or comes no closer to them; from what each round was off by."""
    return bool(history) and (history[-1] < CLOSE or len(history) > PATIENCE and min(history[-PATIENCE:]) >= 0.99 * min(history[:-PATIENCE]))


def rake(cells: pd.DataFrame, targets: dict[str, pd.Series]) -> tuple[np.ndarray, float]:
    """The tokens that each cell should have: its own, scaled to meet each column's marginal in turn until all are met; and by
    how much of itself a marginal is off at most in the end (not 0 if the cells that exist can't meet all)."""
    fitted, total = cells["tokens"].to_numpy(float).copy(), float(cells["tokens"].sum())
    plan = []
    for column, target in targets.items():
        codes, values = pd.factorize(cells[column])
        want = target.reindex(values).fillna(0).to_numpy(float)
        plan.append((codes, want / want.sum() * total if want.sum() else want))

    def scales() -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        for codes, want in plan:
            have = np.bincount(codes, fitted, len(want))
            scale = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            yield codes, scale, float(np.abs(scale[have > 0] - 1).max(initial=0))

    history = []
    while len(history) < ROUNDS and not settled(history):
        worst = 0.0
        for codes, scale, off in scales():
            worst = max(worst, off)
            fitted *= scale[codes]
        history.append(worst)
    return fitted, max((off for *_, off in scales()), default=0.0)


def rake_frames(cells: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, float]:
    """The same for cells that are too many for the driver: cells with `fitted`, and what the last round was off by."""
    history, total = [], float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now, plan = cells.withColumn("fitted", F.col("tokens").cast("double")), {}
    for c, t in targets.items():
        used = t.join(cells.select(F.col(c).alias("value")).distinct(), "value")
        asked = used.agg(F.sum("target")).first()[0] or 1.0
        plan[c] = staged(used.select("value", (F.col("target") / asked * total).alias("want")))
    while len(history) < ROUNDS and not settled(history):
        worst = 0.0
        for c, want in plan.items():
            have = now.groupBy(F.col(c).alias("value")).agg(F.sum("fitted").alias("have")).join(want, "value", "left")
            scale = staged(have.select("value", F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("scale"), "have"))
            worst = max(worst, scale.where("have > 0").agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
            now = staged(now.join(scale.select(F.col("value").alias(c), "scale"), c).withColumn("fitted", F.col("fitted") * F.col("scale")).drop("scale"))
        history.append(worst)
    return now, history[-1]


def level(pieces: list[tuple[float, float]], budget: float) -> float:
    """s such that the sum of tokens * min(1, s * ratio) is the budget; pieces: (ratio, tokens), of which ratios may repeat."""
    fixed, rest = 0.0, sorted(((r, t) for r, t in pieces if r > 0), reverse=True)
    slope = sum(r * t for r, t in rest)
    for r, t in rest:
        if slope <= 0 or (budget - fixed) / slope * r <= 1:
            break
        fixed, slope = fixed + t, slope - r * t
    return max(0.0, (budget - fixed) / slope) if slope > 1e-12 else float("inf")


def mix_to_targets(docs: DataFrame, targets: dict[str, Target], fraction: float, seed: int = 0, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the columns of `targets` as strings, n_tokens (long), weight, probability, gap (double), kept (boolean) per row, then
    the columns of `carry`.

    targets: column -> target share of each value (OTHERS: of all that are not named), or a power to which the values' own token
    shares are raised, or another column and a power that holds within its values. A target "topic" of a table without such a column is met with learned topics. Tokens are summed by the
    columns' values; the sums are raked to all marginals, and a cell's weight is its raked tokens over its own. gap is by how
    much of itself a raked marginal still is off. A document is kept with probability min(1, s * weight), s such that
    `fraction` of all tokens stays on average, by a hash of the seed and its id: the same in every run and on every machine.

    A null value is the value ""; a value without a target gets weight 0; a target without documents is left out. Null or
    blank text: 0 tokens. Repeated rows are kept or not together; null ids share one draw. An empty table gives no rows.
    If a raked cell needs more than all its documents it gives all. Texts are read once; topics are learned from their bags of
    hashed words, all of them, which are staged. Cells go to the driver up to DRIVER_CELLS and are raked by Spark beyond; they are broadcast to the rows up to the
    same number and joined by shuffle beyond."""
    dims, spark = list(targets), docs.sparkSession
    learn = "topic" in dims and "topic" not in docs.columns
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"dim_{k}") for k, c in enumerate(dims) if c in docs.columns]
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry if c != text_col]).alias("carried")  # a text goes to the workers once
    rows = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried, *named), learn, text_col in carry)
    rows = rows.select("id", "carried", *(["text"] if text_col in carry else []), "n_tokens", *[F.col(f"dim_{k}" if c in docs.columns else "topic").alias(f"dim_{k}") for k, c in enumerate(dims)])
    keys = [f"dim_{k}" for k in range(len(dims))]
    with scratch(spark):
        cells = staged(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")))
        n = cells.count()
        asked = {k: (keys[dims.index(t[0])], t[1]) if isinstance(t := targets[c], tuple) else t for k, c in zip(keys, dims, strict=True)}
        frames = {k: target_of(cells, k, asked) for k in keys}
        if n <= DRIVER_CELLS:
            own = cells.toPandas().sort_values(keys, ignore_index=True)
            fitted, gap = rake(own, {k: f.toPandas().set_index("value")["target"] for k, f in frames.items()})
            own["weight"] = np.divide(fitted, own["tokens"], out=np.zeros(len(own)), where=own["tokens"].to_numpy() > 0)
            s = level(list(zip(own["weight"], own["tokens"].astype(float), strict=True)), fraction * float(own["tokens"].sum()))
            weights = spark.createDataFrame(own[[*keys, "weight"]].values.tolist(), ", ".join(f"{k} string" for k in keys) + ", weight double")
        else:
            ratio = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(0.0)
            raked, gap = rake_frames(cells, frames)
            weights = staged(raked.withColumn("weight", ratio), keep=True)
            total, low, high = float(weights.agg(F.sum("tokens")).first()[0] or 0), 0.0, 2.0**60
            for _ in range(120):  # halving: the same s as level() to the last digits
                s = (low * high) ** 0.5 if low else high / 2**30
                got = weights.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s))).first()[0] or 0
                low, high = (s, high) if got < fraction * total else (low, s)
                if low and high / low < 1 + 1e-12:
                    break
            weights = weights.select(*keys, "weight")
    out = rows.join(broadcast_if_small(weights, n, DRIVER_CELLS), keys)
    probability = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(s))).otherwise(0.0)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11) / F.lit(float(1 << 53))
    return out.select(
        F.col("id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(keys, dims, strict=True)], "n_tokens", "weight", probability.alias("probability"), F.lit(gap).alias("gap"),
        (draw < probability).alias("kept"), *[(F.col("text") if c == text_col else F.col("carried")[c]).alias(c) for c in carry])
