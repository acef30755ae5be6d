"""Concurrency, uniqueness, sample weights and bootstraps."""

from __future__ import annotations

import math
import random
import zlib
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concurrency(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars (symbol, i) with c, the number of events (symbol, i0, i1) that hold them, by a sweep; an open event lasts to the last bar."""
    ends = events.filter("i1 is not null").select("symbol", (F.col("i1") + 1).alias("i"), F.lit(-1).alias("d"))
    turns = events.select("symbol", F.col("i0").alias("i"), F.lit(1).alias("d")).union(ends).groupBy("symbol", "i").agg(F.sum("d").alias("d"))
    w = W.partitionBy("symbol").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return bars.join(turns, ["symbol", "i"], "left").withColumn("c", F.coalesce(F.sum("d").over(w), F.lit(0)).cast("long")).drop("d")


def weights(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events with tw (mean of 1/c over their bars) and w (|sum of log returns / c|, scaled to mean 1 by symbol).

    Sums over an event's bars are differences of running sums, so that events of any length cost two lookups each.
    """
    own = W.partitionBy("symbol").orderBy("i")
    run = own.rowsBetween(W.unboundedPreceding, 0)
    b = concurrency(events, bars)
    b = b.withColumn("_r", F.log("price") - F.log(F.lag("price").over(own)))
    b = b.withColumn("_u", F.sum(F.coalesce(F.try_divide(F.lit(1.0), F.col("c")), F.lit(0.0))).over(run)).withColumn("_a", F.sum(F.coalesce(F.try_divide(F.col("_r"), F.col("c")), F.lit(0.0))).over(run))
    last = bars.groupBy("symbol").agg(F.max("i").alias("_last"))
    e = events.join(last, "symbol").withColumn("_to", F.coalesce("i1", "_last"))
    at = lambda name, tag: b.select("symbol", F.col("i").alias(name), F.col("_u").alias(f"_u{tag}"), F.col("_a").alias(f"_a{tag}"))
    e = e.withColumn("_from", F.col("i0") - 1).join(at("_to", 1), ["symbol", "_to"]).join(at("_from", 0), ["symbol", "_from"], "left")
    e = e.withColumn("tw", (F.col("_u1") - F.coalesce("_u0", F.lit(0.0))) / (F.col("_to") - F.col("i0") + 1)).withColumn("w_raw", F.abs(F.col("_a1") - F.coalesce("_a0", F.lit(0.0))))
    every = W.partitionBy("symbol")
    e = e.withColumn("w", F.try_divide(F.col("w_raw") * F.count("*").over(every), F.sum("w_raw").over(every)))
    return e.drop("_last", "_to", "_from", "_u0", "_u1", "_a0", "_a1")


def indicator(events: DataFrame) -> DataFrame:
    """(symbol, event, i): the bars of each event, the sparse form of the indicator matrix."""
    return events.filter("i1 is not null").select("symbol", "event", F.explode(F.sequence("i0", "i1")).alias("i"))


def uniqueness(ind: DataFrame) -> DataFrame:
    """Mean of 1/c over an event's bars, from the indicator."""
    c = ind.groupBy("symbol", "i").agg(F.count("*").alias("c"))
    return ind.join(c, ["symbol", "i"]).groupBy("symbol", "event").agg(F.avg(1.0 / F.col("c")).alias("u"))


def decay(df: DataFrame, last: float = 1.0, exponent: float = 1.0, out: str = "decay") -> DataFrame:
    """Linear decay on the running sum of tw in time order; ``last`` is the oldest weight, negative to cut off a share."""
    if last <= -1:
        raise ValueError("last has to be over -1")
    x = F.sum("tw").over(W.partitionBy("symbol").orderBy("i0").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("tw").over(W.partitionBy("symbol"))
    slope = F.pow((1 - last) / total if last >= 0 else 1 / ((last + 1) * total), F.lit(float(exponent)))
    return df.withColumn(out, F.greatest(F.lit(0.0), (1 - slope * total) + slope * x))


def combined(df: DataFrame, last: float = 1.0, exponent: float = 1.0) -> DataFrame:
    """Weight, the product of the weight by returns and the decay."""
    return decay(df, last, exponent, "_decay").withColumn("weight", F.col("w") * F.col("_decay")).drop("_decay")


def decay_curves(df: DataFrame, lasts: tuple[float, ...] = (1, 0.75, 0.5, 0, -0.25, -0.5), exponent: float = 1.0) -> DataFrame:
    """The data of the decay plot, in long form."""
    for k, c in enumerate(lasts):
        df = decay(df, c, exponent, f"_c{k}")
    pairs = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("last"), F.col(f"_c{k}").alias("decay")) for k, c in enumerate(lasts))))
    return df.select("symbol", "i0", pairs.alias("x")).select("symbol", "i0", "x.last", "x.decay")


class Draws:
    """Weighted draws of events whose weights fall with every draw.

    Weights are the leaves of a tree of sums with BRANCH children a node. A draw lowers the uniqueness of the bars that it covers, and with
    that the weights of the events which overlap it: those stand side by side in the order of starts, so that weights and sums are
    changed on one stretch a level.
    """

    BRANCH = 64

    def __init__(self, spans: np.ndarray) -> None:
        """``spans``: (events, 2), first and last bar, sorted by first bar."""
        self.first, self.last = spans[:, 0], spans[:, 1]
        self.size = self.last - self.first + 1
        self.base = int(self.first.min(initial=0))
        self.cover = np.zeros(int(self.last.max(initial=-1)) - self.base + 2)
        #: no event that starts before the first one whose end reaches a bar overlaps it
        self.reach = np.maximum.accumulate(self.last)
        self.levels = [np.zeros(-(-len(spans) // self.BRANCH) * self.BRANCH)]
        self.levels[0][: len(spans)] = 1.0
        while len(self.levels[-1]) > self.BRANCH:
            sums = self.levels[-1].reshape(-1, self.BRANCH).sum(axis=1)
            self.levels.append(np.pad(sums, (0, -len(sums) % self.BRANCH)))

    def drawn(self, at: float) -> int:
        """The event at the share ``at`` of the weights' sum."""
        left, node = at * float(self.levels[-1].sum()), 0
        for level in reversed(self.levels):
            sums = np.cumsum(level[node * self.BRANCH : (node + 1) * self.BRANCH])
            k = min(int(np.searchsorted(sums, left, side="right")), len(sums) - 1)
            left -= float(sums[k - 1]) if k else 0.0
            node = node * self.BRANCH + k
        return min(node, len(self.first) - 1)

    def cover_with(self, event: int) -> None:
        a, b = int(self.first[event]), int(self.last[event])
        c = self.cover[a - self.base : b - self.base + 1]
        fall = np.concatenate([[0.0], np.cumsum(1 / (2 + c) - 1 / (1 + c))])
        c += 1
        lo, hi = int(np.searchsorted(self.reach, a)), int(np.searchsorted(self.first, b, side="right"))
        s, e = np.clip(self.first[lo:hi], a, b + 1) - a, np.clip(self.last[lo:hi] + 1, a, b + 1) - a
        self.levels[0][lo:hi] += np.where(e > s, (fall[e] - fall[np.minimum(s, e)]) / self.size[lo:hi], 0.0)
        for below, level in zip(self.levels[:-1], self.levels[1:], strict=True):
            lo, hi = lo // self.BRANCH, -(-hi // self.BRANCH)
            level[lo:hi] = below[lo * self.BRANCH : hi * self.BRANCH].reshape(-1, self.BRANCH).sum(axis=1)


def sequential_bootstrap(spans: list[tuple[int, int]] | np.ndarray, draws: int, seed: int) -> list[int]:
    """Places of drawn events; each draw has a probability in proportion to the event's uniqueness given the draws so far, the mean of
    1 / (1 + cover) over its bars. A draw costs the logarithm of the events, and the events that overlap it."""
    spans = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
    if not len(spans):
        return []
    rng, order = random.Random(seed), np.lexsort((spans[:, 1], spans[:, 0]))
    tree, out = Draws(spans[order]), []
    for _ in range(draws):
        k = tree.drawn(rng.random())
        out.append(int(order[k]))
        tree.cover_with(k)
    return out


#: Events of a slice of the draws, about; bars that a slice looks beyond its own, in mean spans; draws in slices are for events of so many
#: proposals at most, as those of many overlapping events are mostly turned down; bins of a unit of time.
SLICE, BEYOND, PROPOSALS, BINS = 1 << 15, 64, 16.0, 512
_U = np.uint64
_DEALT = pa.schema([("symbol", pa.string()), ("_key", pa.int64()), ("_a", pa.int64()), ("_b", pa.int64()), ("slice", pa.int32())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(streams: np.ndarray, k: int) -> np.ndarray:
    """The k-th number in [0, 1) of each stream."""
    return (_mixed(streams + _U((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> _U(11)).astype(np.float64) / 2.0**53


def _streams(symbol: str | None, keys: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(_mixed(keys.astype(np.int64).view(_U)) ^ _U(zlib.crc32(f"{seed}/{symbol}".encode()) << 32 | zlib.adler32(f"{symbol}/{seed}".encode())))


def proposals(streams: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(event, time, mark) of a Poisson process of rate 1 for each stream, in the order of time."""
    events, times, marks = [], [], []
    at, t, k = np.arange(len(streams)), np.zeros(len(streams)), 0
    while len(at):
        t = t - np.log1p(-_uniform(streams[at], 2 * k))
        at, t = at[t <= until], t[t <= until]
        events.append(at)
        times.append(t)
        marks.append(_uniform(streams[at], 2 * k + 1))
        k += 1
    e, t, u = (np.concatenate(x) if x else np.zeros(0) for x in (events, times, marks))
    order = np.argsort(t, kind="stable")
    return e[order].astype(np.int64), t[order], u[order]


def thinned(spans: np.ndarray, events: np.ndarray, marks: np.ndarray, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which proposals are drawn for sure, and which may be: those with a mark under the event's uniqueness, the mean of 1 / (1 + cover) over its
    bars, given the draws before. Bars before ``low`` and from ``high`` on may be covered by events that are not here, any number of times:
    covers are held as bounds, and what is sure and what may be is the same where nothing of that reaches."""
    base, end = int(spans[:, 0].min()), int(spans[:, 1].max()) + 1
    least, most = [0] * (end - base), [0] * (end - base)
    # 1 / (1 + cover) by the bounds
    top, bottom = [1.0] * (end - base), [1.0] * (end - base)
    for a, b in ((base, base if low is None else min(low, end)), (end if high is None else max(high, base), end)):
        if a < b:
            bottom[a - base : b - base] = [0.0] * (b - a)
            most[a - base : b - base] = [math.inf] * (b - a)
    first, last = (spans[:, 0] - base).tolist(), (spans[:, 1] + 1 - base).tolist()
    sure, may = np.zeros(len(events), dtype=bool), np.zeros(len(events), dtype=bool)
    for n, (e, u) in enumerate(zip(events.tolist(), marks.tolist(), strict=True)):
        a, b = first[e], last[e]
        u *= b - a
        if sum(top[a:b]) <= u:
            continue
        may[n] = True
        known = sum(bottom[a:b]) > u
        most[a:b] = now = [c + 1 for c in most[a:b]]
        bottom[a:b] = [1 / (1 + c) for c in now]
        if known:
            sure[n] = True
            least[a:b] = now = [c + 1 for c in least[a:b]]
            top[a:b] = [1 / (1 + c) for c in now]
    return sure, may


def _whole_draws(df: DataFrame, seeds: list[int], key: str) -> DataFrame:
    """(symbol, key, seed, times), a symbol and seed a task: for events of which very many overlap."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        own = int(pdf["seed"].iloc[0])
        pdf = pdf.sort_values(key, kind="stable")
        drawn = sequential_bootstrap(pdf[["_a", "_b"]].to_numpy(), len(pdf), own)
        times = np.bincount(drawn, minlength=len(pdf))
        return pd.DataFrame({"symbol": pdf["symbol"], key: pdf[key], "seed": own, "times": times})[times > 0]

    df = df.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))
    # a few groups, each of much work: so many partitions that they seldom share one
    return df.repartition(200, "symbol", "seed").groupBy("symbol", "seed").applyInPandas(draw, f"symbol string, `{key}` long, seed long, times long")


def _draws_in_slices(df: DataFrame, seeds: list[int], key: str, cuts: dict, until: dict, beyond: dict) -> DataFrame:
    """(symbol, key, seed, at): all draws till ``until``, by symbol. A slice whose draws others may still change is told again, as it
    looks farther and farther beyond its bars."""
    from ..session import cut

    spark = df.sparkSession
    out, asked = None, None
    while True:
        told, reach, only = spark.sparkContext.broadcast((cuts, until)), dict(beyond), asked

        def dealt(batches):
            for batch in batches:
                pdf = batch.to_pandas()
                for symbol, rows in pdf.groupby("symbol", dropna=False, sort=False):
                    symbol = None if symbol is None or symbol != symbol else symbol
                    if symbol not in told.value[1]:
                        continue
                    at, far = told.value[0][symbol], reach[symbol]  # noqa: B023
                    a = np.searchsorted(at, rows["_a"].to_numpy() - far, side="right")
                    n = np.searchsorted(at, rows["_b"].to_numpy() + far, side="right") - a + 1
                    rows = rows.loc[rows.index.repeat(n)]
                    rows = rows.assign(slice=np.repeat(a, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n))
                    if only is not None:  # noqa: B023
                        rows = rows[rows["slice"].isin([k for s, k in only if s == symbol])]  # noqa: B023
                    yield pa.RecordBatch.from_pandas(rows, schema=_DEALT, preserve_index=False)

        def draw(pdf: pd.DataFrame) -> pd.DataFrame:
            symbol, k = pdf["symbol"].iloc[0], int(pdf["slice"].iloc[0])
            at, far, end = told.value[0][symbol], reach[symbol], told.value[1][symbol]  # noqa: B023
            pdf = pdf.sort_values(["_a", "_b", "_key"], kind="stable")
            spans, keys = pdf[["_a", "_b"]].to_numpy(), pdf["_key"].to_numpy()
            # whole slices go by their first bars: the first and the last slice of a symbol are open
            low, high = (int(at[k - 1]) if k else None), (int(at[k]) if k < len(at) else None)
            own = np.ones(len(spans), dtype=bool) if low is None else spans[:, 0] >= low
            own &= True if high is None else spans[:, 0] < high
            parts = []
            for seed in seeds:
                e, t, u = proposals(_streams(symbol, keys, seed), end)
                sure, may = thinned(spans, e, u, None if low is None else low - far, None if high is None else high + far)
                mine = own[e]
                parts.append(pd.DataFrame({"symbol": symbol, key: keys[e[mine & sure]], "seed": seed, "at": t[mine & sure], "slice": k, "open": bool((mine & may & ~sure).any())}))
                if not len(parts[-1]) and (mine & may).any():
                    parts.append(pd.DataFrame({"symbol": [symbol], key: [0], "seed": [seed], "at": [0.0], "slice": [k], "open": [True]}))
            return pd.concat(parts)

        slices = sum(len(x) + 1 for x in cuts.values()) if asked is None else len(asked)
        rows = df.mapInArrow(dealt, "symbol string, _key long, _a long, _b long, slice int")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices)
        now = cut(rows.repartition(parts, "symbol", "slice").groupBy("symbol", "slice").applyInPandas(draw, f"symbol string, `{key}` long, seed long, at double, slice int, open boolean"))
        left = now.filter("open").select("symbol", "slice").distinct()
        asked = [(r.symbol, r.slice) for r in left.collect()]
        done = now.join(F.broadcast(left.withColumnRenamed("symbol", "_s").withColumnRenamed("slice", "_k")), F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_k")), "left_anti") if asked else now
        done = done.select("symbol", key, "seed", "at")
        out = done if out is None else out.union(done)
        if not asked:
            return out
        beyond = {s: 8 * v + 1 for s, v in beyond.items()}


def bootstrap_counts(events: DataFrame, seed: int | list[int], first: str = "i0", last: str = "i1", key: str = "pos") -> DataFrame:
    """(symbol, key, times): how often each of a symbol's events is drawn in as many draws as it has events; of several seeds also
    seed. An event without an end is not drawn; keys are unique in a symbol.

    Draws go by clocks: each event rings at the rate of its uniqueness given the draws so far, and the first rings of all, as many as there
    are events, are the draws: the next one is each event's with a probability in proportion to its uniqueness, as in W7. Rings
    depend on those of overlapping events alone, so slices of a symbol are drawn side by side, with some of their neighbours' events.
    """
    from ..session import ship

    ship(events.sparkSession)
    df = events.select("symbol", F.col(key).cast("long").alias("_key"), F.col(first).cast("long").alias("_a"), F.col(last).cast("long").alias("_b")).filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    seeds = [seed] if isinstance(seed, int) else seed
    size = F.col("_b") - F.col("_a") + 1
    facts = {r.symbol: r for r in df.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(size).alias("size"), (F.max("_b") - F.min("_a") + 1).alias("bars")).collect()}
    # draws till time t cover a bar n(t) * size / bars times about, so that the n-th comes at 1 + C / 2 or before
    until = {s: (1 + r["size"] / r["bars"] / 2) * (1 + 4 / r["n"] ** 0.5) for s, r in facts.items()}
    whole = [s for s, t in until.items() if t > PROPOSALS * (1 + 4 / facts[s]["n"] ** 0.5)]
    until = {s: t for s, t in until.items() if s not in whole}
    own = lambda names: F.lit(False) if not names else reduce(or_, (F.col("symbol").eqNullSafe(F.lit(s)) for s in names))
    out = [_whole_draws(df.filter(own(whole)).withColumnRenamed("_key", key), seeds, key).select("symbol", key, "seed", "times")] if whole else []
    while until:
        parts = -(-max(facts[s]["n"] for s in until) // SLICE)
        cuts = {s: np.zeros(0, dtype=np.int64) for s in until}
        if parts > 1:
            at = df.groupBy("symbol").agg(F.percentile_approx("_a", [k / parts for k in range(1, parts)], 100 * parts).alias("x")).collect()
            for r in at:
                if r.symbol in cuts:
                    cuts[r.symbol] = np.unique(np.array(r.x[:: max(1, parts * SLICE // facts[r.symbol]["n"])], dtype=np.int64)) if facts[r.symbol]["n"] > SLICE else cuts[r.symbol]
        beyond = {s: BEYOND * -(-facts[s]["size"] // facts[s]["n"]) for s in until}
        drawn = _draws_in_slices(df.filter(own(list(until))), seeds, key, cuts, until, beyond).withColumn("bin", F.floor(F.col("at") * BINS))
        counts = drawn.groupBy("symbol", "seed", "bin").agg(F.count("*").alias("n"))
        counts = counts.withColumn("before", F.sum("n").over(W.partitionBy("symbol", "seed").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)))
        wanted = df.sparkSession.createDataFrame([(s, facts[s]["n"]) for s in until], "_s string, wanted long")
        counts = counts.withColumn("before", F.coalesce("before", F.lit(0))).join(F.broadcast(wanted), F.col("symbol").eqNullSafe(F.col("_s"))).drop("_s")
        ends = {(r.symbol, r.seed): (r.bin, r.need) for r in counts.filter("before < wanted and before + n >= wanted").selectExpr("symbol", "seed", "bin", "wanted - before as need").collect()}
        short = [s for s in until if any((s, x) not in ends for x in seeds)]
        limits = df.sparkSession.createDataFrame([(s, x, *v) for (s, x), v in ends.items() if s not in short], "_s string, _x long, _bin long, _need long")
        kept = drawn.join(F.broadcast(limits), F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("seed") == F.col("_x")) & (F.col("bin") <= F.col("_bin")))
        # the last bin alone is put in order
        final = kept.filter("bin = _bin").withColumn("_r", F.row_number().over(W.partitionBy("symbol", "seed").orderBy("at", key))).filter("_r <= _need")
        cols = ["symbol", key, "seed"]
        out.append(kept.filter("bin < _bin").select(*cols).union(final.select(*cols)).groupBy(*cols).agg(F.count("*").alias("times")))
        until = {s: 1.5 * until[s] for s in short}
    if not out:
        return df.select("symbol", F.col("_key").alias(key), F.lit(0).cast("long").alias("seed"), F.lit(0).cast("long").alias("times")).drop(*(["seed"] if isinstance(seed, int) else [])).limit(0)
    whole_list = reduce(DataFrame.union, out)
    return whole_list.drop("seed") if isinstance(seed, int) else whole_list


def mean_uniqueness(spans: list[tuple[int, int]]) -> float:
    cover: dict[int, int] = {}
    for a, b in spans:
        for i in range(a, b + 1):
            cover[i] = cover.get(i, 0) + 1
    return sum(sum(1 / cover[i] for i in range(a, b + 1)) / (b - a + 1) for a, b in spans) / len(spans)


def bootstrap_trials(spark, trials: int = 100, events: int = 10, bars: int = 100, longest: int = 5, seed: int = 0) -> DataFrame:
    """(trial, std_u, seq_u): mean uniqueness of a plain and of a sequential bootstrap of random spans, trials in parallel."""

    def run(it):
        for pdf in it:
            rows = []
            for t in pdf["id"]:
                rng = random.Random(seed * 1_000_003 + int(t))
                found = {}
                for _ in range(events):
                    a = rng.randrange(bars)
                    found[a] = a + rng.randrange(1, max(2, longest))
                spans = sorted(found.items())
                plain = [spans[rng.randrange(len(spans))] for _ in spans]
                seq = [spans[k] for k in sequential_bootstrap(spans, len(spans), int(t))]
                rows.append((int(t), mean_uniqueness(plain), mean_uniqueness(seq)))
            yield pd.DataFrame(rows, columns=["trial", "std_u", "seq_u"])

    from ..session import ship

    return ship(spark).range(trials).mapInPandas(run, "trial long, std_u double, seq_u double")


def random_spans(spark, n: int, bars: int, longest: int, seed: int = 0) -> DataFrame:
    """Random events; of repeated starts the last one stays."""
    df = spark.range(n).select("id", F.floor(F.rand(seed) * bars).cast("long").alias("i0"), F.floor(1 + F.rand(seed + 1) * (longest - 1)).cast("long").alias("_l"))
    return df.groupBy("i0").agg(F.max_by("_l", "id").alias("_l")).select("i0", (F.col("i0") + F.col("_l")).alias("i1"))


def balanced(df: DataFrame, label: str = "bin") -> DataFrame:
    """class_weight, n / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    n = n.withColumn("class_weight", F.sum("_n").over(W.partitionBy()) / (F.count("*").over(W.partitionBy()) * F.col("_n"))).drop("_n")
    return df.join(n, label)
