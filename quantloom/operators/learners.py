"""Learners that MLlib lacks: kernel machines by random features (M3), second-order boosted trees (M4), exact nearest neighbours (M7), and
logistic fits of all splits and candidates in one pass (M11, M14, M18, C4).

What is summed over rows is summed by key within tasks, then over tasks by key; the driver sees totals, whose number does not grow with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, ship

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
#: What a task makes of a batch: sums by key.
Sums = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def totals(df: DataFrame, sums: Sums) -> dict[int, np.ndarray]:
    """The sums by key over all rows: one job with one shuffle of a row a task and key."""
    ship(df.sparkSession)

    def added(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for key, x in pairs:
            held[key] = held[key] + x if key in held else x
        for key, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.ascontiguousarray(x, dtype=np.float64).tobytes()], pa.binary())], ["key", "sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(pair for batch in batches if len(batch) for pair in sums(batch))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added((k, np.frombuffer(x)) for batch in batches for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    rows = df.mapInArrow(part, "key long, sums binary").repartition("key").mapInArrow(whole, "key long, sums binary").collect()
    return {r["key"]: np.frombuffer(r["sums"]) for r in rows}


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names], axis=1) if names else np.zeros((len(batch), 0))


def added(df: DataFrame, outputs: str, made: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``made`` gives for each batch, in the stead of those of the same names."""
    ship(df.sparkSession)
    names = [x.split()[0] for x in outputs.split(", ")]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made(batch)], [*(f.name for f in kept), *names])

    return df.mapInArrow(run, schema)


def complete(df: DataFrame, features: list[str]) -> DataFrame:
    """The rows without a null or nan among ``features``: the others are not learned from."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return df.filter(ok)


def moments(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations; 1 where a feature does not vary."""
    r = df.agg(*(F.avg(f) for f in features), *(F.stddev_samp(f) for f in features)).first()
    mean, spread = (np.array([0.0 if v is None else float(v) for v in x]) for x in (r[: len(features)], r[len(features) :]))
    return mean, np.where(spread > 0, spread, 1.0)


def balance(df: DataFrame) -> dict[int, float]:
    """The weight of each label: rows / (labels * rows of the label)."""
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    return {k: sum(n.values()) / (len(n) * v) for k, v in n.items()}


# --- M3 ----------------------------------------------------------------------

#: Components of mapped rows that one task reads, about, at most.
MAPPED = 1 << 23


def rbf_svc(features: list[str], components: int = 256, gamma: float | None = None, reg: float = 1e-3, rounds: int = 100, folds: int = 3, seed: int = 12) -> Fit:
    """M3: a machine with a radial kernel exp(-gamma |x - y|^2), by random Fourier features, with balanced labels.

    The score is a logistic function of the margin, fitted on margins of rows that the machine had not seen: ``folds`` fits on the other folds,
    by a hash of the row's features. Features are scaled; ``gamma`` is 1 / features unless given. Rows with nulls are not learned
    from, and score 0.5.
    """

    def fit(train: DataFrame):
        train = complete(train, features)
        mean, spread = moments(train, features)
        rng = np.random.default_rng(seed)
        g = gamma or 1 / len(features)
        w, b = rng.standard_normal((len(features), components)) * np.sqrt(2 * g), rng.uniform(0, 2 * np.pi, components)

        def mapped(batch: pa.RecordBatch) -> list[pa.Array]:
            x = (matrix(batch, features) - mean) / spread
            z = np.sqrt(2 / components) * np.cos(np.nan_to_num(x) @ w + b)
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, components, dtype=np.int32)), pa.array(z.ravel()))]

        def with_map(df: DataFrame) -> DataFrame:
            return added(df, "_z array<double>", mapped).withColumn("_z", array_to_vector("_z"))

        weight = F.lit(1.0)
        for k, v in balance(train).items():
            weight = F.when(F.col("label") == k, v).otherwise(weight)
        fold = F.pmod(F.xxhash64(*features), F.lit(folds)).cast("int")
        own = train.select(*features, "label", weight.alias("_w"), fold.alias("_fold"))
        # rows come by symbol, and a mapped one has 8 bytes a component: each pass reads them in parts of bounded size
        own = own.repartition(max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() * components // MAPPED)))
        df = cut(with_map(own).select("label", "_w", "_fold", "_z"))
        machine = LinearSVC(maxIter=rounds, regParam=reg, featuresCol="_z", labelCol="label", weightCol="_w", standardization=False)
        margin = F.get(vector_to_array("rawPrediction"), 1)
        unseen = None
        for k in range(folds):
            out = machine.fit(df.filter(F.col("_fold") != k)).transform(df.filter(F.col("_fold") == k)).select(margin.alias("m"), F.col("label").cast("double").alias("label"))
            unseen = out if unseen is None else unseen.union(out)
        slope, shift = _platt(cut(unseen))
        model = machine.fit(df)

        def predict(x: DataFrame) -> DataFrame:
            out = model.transform(with_map(x))
            p = 1 / (1 + F.exp(-(slope * margin + shift)))
            known = F.lit(True)
            for f in features:
                known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
            out = out.withColumn("score", F.when(known, p).otherwise(0.5)).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
            return out.drop("_z", "rawPrediction", "prediction")

        return predict

    return fit


def _platt(df: DataFrame, rounds: int = 30) -> tuple[float, float]:
    """The slope and shift of the logistic function of m that fits the labels best; targets are drawn in from 0 and 1 by the labels' numbers."""
    n1, n0 = df.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    high, low = ((n1 or 0) + 1) / ((n1 or 0) + 2), 1 / ((n0 or 0) + 2)
    c = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("m") * float(c[0]) + float(c[1]))))
        t = F.when(F.col("label") == 1, high).otherwise(low)
        r = df.select("m", (t - p).alias("e"), (p * (1 - p)).alias("h"))
        gm, g1, hmm, hm, h1 = (v or 0.0 for v in r.agg(F.sum(F.col("e") * F.col("m")), F.sum("e"), F.sum(F.col("h") * F.col("m") ** 2), F.sum(F.col("h") * F.col("m")), F.sum("h")).first())
        step = np.linalg.solve(np.array([[hmm + 1e-9, hm], [hm, h1 + 1e-9]]), np.array([gm, g1]))
        c = c + step * min(1.0, 10 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


# --- M4 ----------------------------------------------------------------------


@dataclass
class Tree:
    """A tree of up to 2**depth leaves: node k has the children 2k and 2k + 1; a value under or at the edge goes to the first, nan too."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            down = f >= 0
            if not down.any():
                return at
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            at = np.where(down, 2 * at + (v > self.edge[at]), at)


def margins(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        out += t.value[t.nodes(x)]
    return out


def best_split(g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], reg: float, least: float, gain_over: float) -> tuple[int, float] | None:
    """(feature, edge) of the greatest gain of a node whose gradients and hessians by (feature, bin) are ``g`` and ``h``; the first of equals."""
    best, found = gain_over, None
    for f, e in enumerate(edges):
        gl, hl = np.cumsum(g[f])[: len(e)], np.cumsum(h[f])[: len(e)]
        gt, ht = g[f].sum(), h[f].sum()
        gain = 0.5 * (gl**2 / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt**2 / (ht + reg))
        gain = np.where((hl >= least) & (ht - hl >= least), gain, -np.inf)
        if len(gain) and gain.max() > best + 1e-12:
            best, found = float(gain.max()), (f, float(e[int(gain.argmax())]))
    return found


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """For each feature the edges of its bins, of about equal numbers of rows."""
    shares = [k / bins for k in range(1, bins)]
    rows = df.agg(*(F.percentile_approx(F.col(f).cast("double"), F.array(*map(F.lit, shares)), 10_000).alias(f"q{k}") for k, f in enumerate(features))).first()
    return [np.unique(np.array(rows[k] or [], dtype=np.float64)) for k in range(len(features))]


def newton_trees(features: list[str], rounds: int = 100, depth: int = 3, rate: float = 0.02, reg: float = 1.0, least: float = 1.0, bins: int = 64, weight: str | None = "w") -> Fit:
    """M4: boosted trees for labels 0 and 1 by second-order steps, from a margin of 0.

    Each level of a tree is one aggregate of gradients and hessians by node, feature and bin; splits have the greatest gain, leaves the
    weight -G / (H + reg) times ``rate``; a child has a hessian of ``least`` at least. Rows with nulls are not learned from; where a feature is null, a row
    that is scored goes to the first child.
    """

    def fit(train: DataFrame):
        w = F.col(weight).cast("double") if weight and weight in train.columns else F.lit(1.0)
        df = complete(train, features).select(*(F.col(f).cast("double").alias(f) for f in features), F.col("label").cast("double").alias("_y"), w.alias("_w"))
        edges = quantile_edges(df, features, bins)
        width, last = max(len(e) for e in edges) + 1, 1 << depth
        binned = cut(added(df, "_bins array<int>", lambda batch: [_lists(np.stack([np.searchsorted(e, x, side="left") for e, x in zip(edges, matrix(batch, features).T, strict=True)], axis=1))]))
        trees: list[Tree] = []
        for _ in range(rounds):
            t = Tree(np.full(2 * last, -1), np.zeros(2 * last), np.zeros(2 * last))
            sums: dict[int, np.ndarray] = {}
            for level in range(depth):
                found = totals(binned, _histograms(features, trees, t, 1 << level, width))
                split = False
                for node, x in found.items():
                    g, h = x.reshape(2, len(features), width)
                    sums[node] = np.array([g[0].sum(), h[0].sum()])
                    if (s := best_split(g, h, edges, reg, least, 0.0)) is not None:
                        t.feature[node], t.edge[node], split = s[0], s[1], True
                        k = int(np.searchsorted(edges[s[0]], s[1])) + 1
                        sums[2 * node] = np.array([g[s[0]][:k].sum(), h[s[0]][:k].sum()])
                        sums[2 * node + 1] = np.array([g[s[0]][k:].sum(), h[s[0]][k:].sum()])
                if not split:
                    break
            for node, (g, h) in sums.items():
                t.value[node] = -rate * g / (h + reg)
            trees.append(t)

        def predict(x: DataFrame) -> DataFrame:
            def scored(batch: pa.RecordBatch) -> list[pa.Array]:
                p = 1 / (1 + np.exp(-margins(trees, matrix(batch, features))))
                return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

            return added(x, "score double, pred int", scored)

        predict.trees = trees
        return predict

    return fit


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.astype(np.int32).ravel()))


def _histograms(features: list[str], trees: list[Tree], now: Tree, first: int, width: int) -> Sums:
    """Gradients and hessians by (feature, bin) of the nodes from ``first`` to 2 * first - 1 of the tree that grows."""

    def sums(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = matrix(batch, features)
        bins = batch.column("_bins").flatten().to_numpy().reshape(len(batch), len(features))
        y, w = batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_w").to_numpy(zero_copy_only=False)
        p = 1 / (1 + np.exp(-margins(trees, x)))
        g, h, at = (p - y) * w, p * (1 - p) * w, now.nodes(x)
        for node in np.unique(at[at >= first]).tolist():
            mine = at == node
            flat = bins[mine] + width * np.arange(len(features))
            size = width * len(features)
            rep = lambda v: np.repeat(v[mine], len(features))  # noqa: B023, E731
            yield node, np.concatenate([np.bincount(flat.ravel(), rep(v), size) for v in (g, h)])

    return sums


# --- M7 ----------------------------------------------------------------------


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squares of differences, feature after feature, so that equal rows have equal ones."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        d = a[:, f, None] - b[None, :, f]
        d *= d
        out += d
    return out


#: Rows of a cell, about; cells, at most; sampled rows that a cell is cut by.
CELL, CELLS, SAMPLED = 512, 1 << 15, 8


class Boxes:
    """A tree that halves a sample along its widest feature; its leaves are cells. Nodes are numbered as in a heap, from 1, and know how many
    rows they have, and the box of these."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.depth = max(0, cells - 1).bit_length()
        self.leaves = 1 << self.depth
        self.feature, self.edge = np.zeros(self.leaves, dtype=np.int64), np.full(self.leaves, np.inf)
        parts = {1: sample}
        for node in range(1, self.leaves):
            own = parts.pop(node)
            if len(own):
                f = int(own.std(axis=0).argmax())
                middle = (len(own) - 1) // 2
                self.feature[node], self.edge[node] = f, np.partition(own[:, f], middle)[middle]
            low = own[:, self.feature[node]] <= self.edge[node]
            parts[2 * node], parts[2 * node + 1] = own[low], own[~low]

    def fill(self, cell: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The rows' number, least and greatest features by cell."""
        self.count = np.zeros(2 * self.leaves, dtype=np.int64)
        self.low, self.high = np.full((2 * self.leaves, low.shape[1]), np.inf), np.full((2 * self.leaves, low.shape[1]), -np.inf)
        at = cell + self.leaves
        self.count[at], self.low[at], self.high[at] = count, low, high
        for k in range(self.depth - 1, -1, -1):
            a, b = 1 << k, 2 << k
            self.count[a:b] = self.count[2 * a : 2 * b : 2] + self.count[2 * a + 1 : 2 * b : 2]
            self.low[a:b] = np.minimum(self.low[2 * a : 2 * b : 2], self.low[2 * a + 1 : 2 * b : 2])
            self.high[a:b] = np.maximum(self.high[2 * a : 2 * b : 2], self.high[2 * a + 1 : 2 * b : 2])

    def cells(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[rows, self.feature[node]] > self.edge[node])
        return node - self.leaves

    def first(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The least node above a row's cell that has ``k`` rows, or the root, and how many levels it lies above the cells."""
        node, up = self.cells(x) + self.leaves, np.zeros(len(x), dtype=np.int64)
        while (few := (self.count[node] < k) & (node > 1)).any():
            node, up = np.where(few, node >> 1, node), up + few
        return node, up

    def below(self, node: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells with rows under the rows' nodes."""
        q = np.arange(len(node))
        while (up > 0).any():
            inner = up > 0
            q = np.concatenate([q[~inner], np.repeat(q[inner], 2)])
            node = np.concatenate([node[~inner], (2 * node[inner, None] + [0, 1]).ravel()])
            up = np.concatenate([up[~inner], np.repeat(up[inner] - 1, 2)])
        there = self.count[node] > 0
        return q[there], node[there] - self.leaves

    def near(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose box is no farther than the rows' ``bound``, a square. Boxes hold scaled rows and are measured as these
        are, feature after feature, so no row of a cell that is left out is as near."""
        q, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            q, node = np.repeat(q, 2), (2 * node[:, None] + [0, 1]).ravel()
            there = self.count[node] > 0
            q, node = q[there], node[there]
            far = np.zeros(len(q))
            for f in range(x.shape[1]):
                d = np.maximum(np.maximum(self.low[node, f] - x[q, f], x[q, f] - self.high[node, f]), 0.0)
                far += d * d
            q, node = q[far <= bound[q]], node[far <= bound[q]]
        return q, node - self.leaves


def nearest_neighbours(features: list[str], k: int = 5, cells: int | None = None, block: int = 16_384, scale: bool = True) -> Fit:
    """M7: the share of label 1 among the ``k`` nearest rows, exactly, by Euclidean distance of scaled features; ties go to the lesser (symbol, pos).

    Training rows lie in ``cells`` (rounded up to a power of 2) of a tree that halves sampled rows, in one for each CELL of them unless given. A
    query first asks its own cell, or the cells about it that have ``k`` rows, and then every cell whose box is no farther than the k-th so
    far; these answer with rows as near as that. Blocks of a cell hold ``block`` rows, about. Of rows with equal features only the first ``k``
    can be among the nearest, the others have as many before them; equal queries are asked once. Rows with nulls are not learned from and
    score 0.5.
    """

    def fit(train: DataFrame):
        spark = train.sparkSession
        train = complete(train, features)
        mean, spread = moments(train, features) if scale else (np.zeros(len(features)), np.ones(len(features)))
        x = lambda batch: (matrix(batch, features) - mean) / spread
        own = F.row_number().over(W.partitionBy(*features).orderBy("symbol", "pos"))
        train = train.withColumn("_own", own).filter(F.col("_own") <= k)
        train = cut(train.select("symbol", F.col("pos").cast("long").alias("pos"), F.col("label").cast("int").alias("label"), *features))
        count = train.count()
        if not count:
            return lambda df: df.withColumns({"score": F.lit(0.5), "pred": F.lit(1)})
        wanted = cells or min(CELLS, max(1, count // CELL))
        sample = train.orderBy(F.xxhash64("symbol", "pos"), "symbol", "pos").limit(SAMPLED * wanted).select(*(F.col(f).cast("double") for f in features)).collect()
        tree = Boxes((np.array([list(r) for r in sample]) - mean) / spread, wanted)
        placing = spark.sparkContext.broadcast(tree)

        def placed(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(placing.value.cells(x(batch)).astype(np.int32))]

        cols = ["_cell", "_part", "_ask", "symbol", "pos", "label", *features, "_id", "_bound"]
        rows = cut(added(train, "_cell int", placed))
        sizes = cut(rows.groupBy("_cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("parts"), F.array(*(F.min(f).cast("double") for f in features)).alias("low"), F.array(*(F.max(f).cast("double") for f in features)).alias("high")))
        told = sizes.collect()  # a row a cell
        tree.parts = np.zeros(tree.leaves, dtype=np.int64)
        at = np.array([r["_cell"] for r in told])
        tree.parts[at] = [r["parts"] for r in told]
        tree.fill(at, np.array([r["n"] for r in told]), *((np.array([r[c] for r in told]) - mean) / spread for c in ("low", "high")))
        filled = spark.sparkContext.broadcast(tree)
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count >> 16)
        base = rows.join(F.broadcast(sizes.select("_cell", "parts")), "_cell").withColumn("_part", F.pmod(F.xxhash64("symbol", "pos"), F.col("parts")).cast("int"))
        base = base.withColumns({"_ask": F.lit(False), "_id": F.lit(0).cast("long"), "_bound": F.lit(0.0)}).select(*cols)

        def cells_of(second: bool):
            def made(batch: pa.RecordBatch) -> list[pa.Array]:
                t, v = filled.value, x(batch)
                node, up = t.first(v, k)
                q, cell = t.near(v, batch.column("_bound").to_numpy(zero_copy_only=False)) if second else t.below(node, up)
                if second:
                    new = (cell + t.leaves) >> up[q] != node[q]
                    q, cell = q[new], cell[new]
                n = t.parts[cell]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, cell = np.repeat(q, n), np.repeat(cell, n)
                order = np.argsort(q, kind="stable")
                ends = np.append(0, np.cumsum(np.bincount(q, minlength=len(v)))).astype(np.int32)
                return [pa.ListArray.from_arrays(pa.array(ends), pa.array((cell << 20 | part)[order], pa.int64()))]

            return made

        def asked(queries: DataFrame, second: bool) -> DataFrame:
            """(_id, symbol, pos, distance, label): the k nearest of each block that a query asks, none farther than its bound."""
            q = added(queries, "_cells array<long>", cells_of(second)).withColumn("_at", F.explode("_cells"))
            q = q.withColumns({"_cell": F.shiftright("_at", 20).cast("int"), "_part": F.col("_at").bitwiseAND(F.lit((1 << 20) - 1)).cast("int")})
            q = q.withColumns({"_ask": F.lit(True), "symbol": F.lit(""), "pos": F.lit(0).cast("long"), "label": F.lit(0)}).select(*cols)
            both = base.union(q).repartition(width, "_cell", "_part").sortWithinPartitions("_cell", "_part", "_ask")
            return both.mapInArrow(_nearest(k, x), "_id long, symbol string, pos long, distance double, label int")

        def predict(df: DataFrame) -> DataFrame:
            queries = cut(complete(df, features).select(*features).distinct().withColumn("_id", F.monotonically_increasing_id()))
            queries = queries.withColumn("_bound", F.lit(float("inf")))
            near = cut(asked(queries, False))
            order = "row_number() over (partition by _id order by distance, symbol, pos)"
            kth = near.withColumn("_r", F.expr(order)).filter(F.col("_r") <= k).groupBy("_id").agg(F.max("distance").alias("_b"), F.count("*").alias("_n"))
            bound = F.when(F.col("_n") < k, float("inf")).otherwise(F.col("_b"))
            more = asked(queries.drop("_bound").join(kth.select("_id", bound.alias("_bound")), "_id"), True)
            best = near.union(more).withColumn("_r", F.expr(order)).filter(F.col("_r") <= k).groupBy("_id").agg(F.avg("label").alias("_s"))
            best = queries.join(best, "_id").select("_s", *(F.col(f).alias(f"_q_{f}") for f in features))
            out = df.join(best, reduce(and_, (F.col(f) == F.col(f"_q_{f}") for f in features)), "left").withColumn("score", F.coalesce("_s", F.lit(0.5)))
            return out.withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop("_s", *(f"_q_{f}" for f in features))

        return predict

    return fit


def _nearest(k: int, x: Callable):
    """Rows by (_cell, _part), a block's rows before its queries: for each query its k nearest rows of the block."""

    def told(rows: list[pa.RecordBatch], asks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not rows or not asks:
            return
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        symbol, pos = np.array(table.column("symbol").to_pylist(), dtype=object), table.column("pos").to_numpy()
        order = np.lexsort((pos, np.unique(symbol.astype(str), return_inverse=True)[1]))
        data, label, symbol, pos = x(table)[order], table.column("label").to_numpy()[order], symbol[order], pos[order]
        m = min(k, len(pos))
        for ask in asks:
            step = max(1, 1_000_000 // len(pos))
            for at in range(0, len(ask), step):
                part = ask.slice(at, step)
                d = squares(x(part), data)
                limit = np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1], part.column("_bound").to_numpy(zero_copy_only=False))
                # places are in the order of ties, and so are those of equal distance here
                q, place = np.nonzero(d <= limit[:, None])
                far = d[q, place]
                order = np.lexsort((far, q))
                q, place, far = q[order], place[order], far[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                top = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < m
                q, place, far = q[top], place[top], far[top]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("_id").to_numpy()[q]), pa.array(symbol[place].tolist(), pa.string()), pa.array(pos[place]), pa.array(far), pa.array(label[place].astype(np.int32))],
                    ["_id", "symbol", "pos", "distance", "label"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            cell, part = batch.column("_cell").to_numpy().astype(np.int64), batch.column("_part").to_numpy()
            asks = batch.column("_ask").to_numpy(zero_copy_only=False)
            key = (cell << 32 | part) * 2 + asks
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key[a] >> 1 != now:
                    now, rows = key[a] >> 1, []
                if asks[a]:
                    yield from told(rows, [batch.slice(a, b - a)])
                else:
                    rows.append(batch.slice(a, b - a))

    return run


# --- M11, M14, M18, C4 -------------------------------------------------------


@dataclass
class Logistic:
    """A candidate: its features, and the weight of the squares of its scaled coefficients."""

    features: list[str]
    reg: float = 0.0


def fold_scores(rows: DataFrame, roles: DataFrame, candidates: dict[str, Logistic], scoring: str = "log_loss", rounds: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """(model, split, score) of logistic candidates on all splits of ``roles`` (symbol, split, pos, role).

    A row knows the splits in which it trains and tests. Every Newton step of all candidates and splits is one pass over the rows, and so
    are the scores: the number of jobs is that of the steps, whatever the number of splits and candidates. Rows with nulls take no part.
    """
    names = list(dict.fromkeys(f for c in candidates.values() for f in c.features))
    models = list(candidates.items())
    mine = roles.groupBy("symbol", "pos").agg(F.collect_set(F.when(F.col("role") == "train", F.col("split"))).alias("_train"), F.collect_set(F.when(F.col("role") == "test", F.col("split"))).alias("_test"))
    w = F.col("w").cast("double") if "w" in rows.columns else F.lit(1.0)
    df = complete(rows, names).select("symbol", "pos", F.col("label").cast("double").alias("_y"), w.alias("_w"), *(F.col(f).cast("double").alias(f) for f in names))
    df = cut(df.join(mine, ["symbol", "pos"]))
    splits = sorted({s for r in df.select(F.explode(F.array_union("_train", "_test")).alias("s")).distinct().collect() for s in r})
    place = {s: k for k, s in enumerate(splits)}
    at = {f: k for k, f in enumerate(names)}
    which = [np.array([at[f] for f in c.features], dtype=int) for _, c in models]

    def held(batch: pa.RecordBatch, column: str) -> np.ndarray:
        """(splits, rows): whether a row has the role in a split."""
        out = np.zeros((len(splits), len(batch)), dtype=bool)
        lists = batch.column(column)
        owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
        out[np.array([place[s] for s in lists.flatten().to_pylist()], dtype=int), owner] = True
        return out

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return matrix(batch, names), batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_w").to_numpy(zero_copy_only=False)

    def spread(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x, _, weight = read(batch)
        for s, rows_ in enumerate(held(batch, "_train")):
            v = weight * rows_
            yield s, np.concatenate([[v.sum()], v @ x, v @ (x * x)])

    found, n = totals(df, spread), len(names)
    centre, size = np.zeros((len(splits), n)), np.ones((len(splits), n))
    for s, t in found.items():
        if t[0]:
            centre[s] = t[1 : n + 1] / t[0]
            size[s] = np.sqrt(np.maximum(t[n + 1 :] / t[0] - centre[s] ** 2, 0))
    size = np.where(size > 0, size, 1.0)
    beta = {(m, s): np.zeros(len(which[m]) + 1) for m in range(len(models)) for s in range(len(splits))}

    def probability(x: np.ndarray, m: int, s: int) -> tuple[np.ndarray, np.ndarray]:
        z = np.column_stack([np.ones(len(x)), (x[:, which[m]] - centre[s, which[m]]) / size[s, which[m]]])
        return z, 1 / (1 + np.exp(-np.clip(z @ beta[m, s], -500, 500)))

    left = set(beta)
    for _ in range(rounds):
        if not left:
            break

        def slopes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            x, y, weight = read(batch)
            train = held(batch, "_train")
            for m, s in sorted(left):  # noqa: B023
                r = train[s]
                z, p = probability(x[r], m, s)
                v = weight[r]
                yield m * len(splits) + s, np.concatenate([[v.sum()], z.T @ (v * (y[r] - p)), ((z * (v * p * (1 - p))[:, None]).T @ z).ravel()])

        sums = totals(df, slopes)
        for m, s in sorted(left):
            t, k = sums.get(m * len(splits) + s), len(beta[m, s])
            if t is None or not t[0]:
                left.discard((m, s))
                continue
            ridge = np.diag([0.0, *[models[m][1].reg] * (k - 1)])
            g, h = t[1 : k + 1] / t[0] - ridge @ beta[m, s], t[k + 1 :].reshape(k, k) / t[0] + ridge + 1e-10 * np.eye(k)
            step = np.linalg.solve(h, g)
            beta[m, s] = beta[m, s] + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < tolerance ** 0.5:
                left.discard((m, s))

    def marks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x, y, weight = read(batch)
        test = held(batch, "_test")
        for m in range(len(models)):
            for s in range(len(splits)):
                r = test[s]
                p = np.clip(probability(x[r], m, s)[1], 1e-15, 1 - 1e-15)
                v, yes, said = weight[r], y[r] == 1, p >= 0.5
                yield m * len(splits) + s, np.array([v.sum(), (v * np.where(yes, np.log(p), np.log(1 - p))).sum(), (v * (yes == said)).sum(), (yes & said).sum(), yes.sum() + said.sum()])

    sums = totals(df, marks)
    out = []
    for m, (name, _) in enumerate(models):
        for s, split in enumerate(splits):
            total, loss, hits, both, either = sums.get(m * len(splits) + s, np.zeros(5)).tolist()
            score = {"log_loss": loss / total if total else None, "accuracy": hits / total if total else None, "f1": 2 * both / either if either else 0.0}[scoring]
            out.append((name, int(split), score))
    return rows.sparkSession.createDataFrame(out, "model string, split int, score double")
