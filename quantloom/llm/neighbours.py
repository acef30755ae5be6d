"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one priority queue over all trees, exact reranking.

* The forest is fitted on a bounded sample: a node's hyperplane lies across the line between two random rows of the node, at the median.
  All trees have one depth, so that a leaf is a number, and the first levels name a cell.
* Every row is in a leaf of each tree. Cells are dealt to blocks of at most BLOCK rows.
* A query's radius is the distance of its k-th neighbour within its own block of the first tree. The queue then holds nodes of all trees
  by the least margin on their way: a node on the far side of a hyperplane at distance m may hold a point within radius r with a
  probability that falls with m * sqrt(dimensions) / r, as directions are spread. Leaves are taken while that is under REACH, and until
  LEAST rows are seen in any case. So dense surroundings need few leaves, and where all points are far apart the search goes on to where
  the missing ones may be. There is no bound on what is taken.
* Blocks score the queries that were sent to them in double precision, and give the k best; the best of all blocks are the answer.

Vectors go to each tree's block once, queries to the blocks of their cells with a bitmap of leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import seeds, written

TREES, REACH, K, EVERY = 3, 1.2, 5, 50
#: Rows of the fitting sample, and numbers in it, at most; sampled rows a leaf, at least.
SAMPLE, NUMBERS, IN_LEAF = 16_384, 1 << 22, 12
#: Rows of a block at most (by hashes, so about), and rows a cell by which the number of cells is chosen, from CELLS on.
BLOCK, IN_CELL, CELLS = 32_768, 4096, 16
#: Rows that a query sees at least, and pairs that are scored at once.
LEAST, TOGETHER = 64, 1 << 22
#: Spare places before exact scores: products of matrices may differ from them in the last digits.
SPARE = 16


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by powers of two before, so that no square leaves the range."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, initial=0.0)
    x = np.ldexp(x, -np.frexp(np.where(top > 0, top, 1.0))[1][:, None])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with the same row of ``b``, alike for equal rows wherever they stand."""
    a, b = (np.ldexp(x.astype(np.float64), -np.frexp(np.abs(x).max(axis=1, initial=0.0).astype(np.float64))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


@dataclass
class Forest:
    """directions (trees, nodes, dimensions) and thresholds (trees, nodes) of complete trees: node k has the children 2k and 2k + 1, 1 is the root."""

    depth: int
    cell_depth: int
    directions: np.ndarray
    thresholds: np.ndarray

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each row of ``x`` (unit vectors)."""
        at = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + ((x * self.directions[tree, at]).sum(axis=1) > self.thresholds[tree, at])
        return at - (1 << self.depth)

    def search(self, margins: list[list[float]], bound: float, sizes: list[list[int]]) -> list[list[int]]:
        """For each tree the leaves that a query takes, from its margins at all nodes: best first over all trees, down to ``bound``."""
        first_leaf, seen = 1 << self.depth, 0
        taken: list[list[int]] = [[] for _ in margins]
        queue = [(-np.inf, t, 1) for t in range(len(margins))]
        while queue:
            less, t, node = heapq.heappop(queue)
            if -less < bound and seen >= LEAST:
                break
            if node >= first_leaf:
                taken[t].append(node - first_leaf)
                seen += sizes[t][node - first_leaf]
                continue
            m = margins[t][node]
            # the near side keeps its way's margin, the far side is as far as the hyperplane
            near, far = (2 * node + 1, 2 * node) if m > 0 else (2 * node, 2 * node + 1)
            heapq.heappush(queue, (max(less, -abs(m)), t, near))
            heapq.heappush(queue, (max(less, abs(m)), t, far))
        return taken


def fit(sample: np.ndarray, rows: int, trees: int = TREES) -> Forest:
    """A forest for ``rows`` rows, fitted on the ``sample``."""
    x = unit(sample)
    depth = max(1, int(np.log2(max(2, len(x) // IN_LEAF))))
    cell_depth = min(depth, max(int(np.log2(CELLS)), int(np.log2(max(1, rows // IN_CELL)))))
    dim = x.shape[1]
    directions, thresholds = np.zeros((trees, 1 << depth, dim)), np.zeros((trees, 1 << depth))
    for t in range(trees):
        rng = np.random.default_rng(int(seeds(1, 400 + t)[0]))
        at = np.ones(len(x), dtype=np.int64)
        for level in range(depth):
            for node in range(1 << level, 2 << level):
                mine = np.flatnonzero(at == node)
                d = rng.standard_normal(dim)
                for _ in range(3):  # two rows that are not the same
                    if len(mine) > 1 and (far := np.subtract(*x[rng.choice(mine, 2, replace=False)])).any():
                        d = far
                        break
                directions[t, node] = d / np.sqrt((d * d).sum())
                if len(mine):
                    thresholds[t, node] = np.median((x[mine] * directions[t, node]).sum(axis=1))
            at = 2 * at + ((x * directions[t, at]).sum(axis=1) > thresholds[t, at])
    return Forest(depth, cell_depth, directions, thresholds)


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """A column of lists of ``dim`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dim)


def _rows(x: np.ndarray) -> pa.Array:
    """The rows of ``x`` as binary."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * size, size, dtype=np.int32)), pa.py_buffer(x.tobytes())])


def _few(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those that k + 1 equal ones with smaller ids go before: no answer can name them."""
    x = np.ascontiguousarray(x)
    _, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    turn = np.arange(len(ids)) - np.searchsorted(same[order], same[order])
    return np.sort(order[turn <= k])


class _Index:
    """What blocks are made by: the forest, the vectors' form, and how many chunks each cell has."""

    def __init__(self, forest: Forest, dim: int, kind: type, k: int, every: int) -> None:
        self.forest, self.dim, self.kind, self.k, self.every = forest, dim, kind, k, every
        self.cells = 1 << forest.cell_depth
        self.under = forest.depth - forest.cell_depth
        #: (trees, cells): chunks, and the number of the first of them
        self.chunks = self.first = np.zeros((0, 0), dtype=np.int64)
        self.sizes: list[list[int]] = []

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, vectors, unit vectors) of some rows; of equal rows that stand together only those that an answer can name, and queries."""
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.slice(at, 8192)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), self.dim, self.kind)
                yield ids, x, unit(x)

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tree, leaf, n) of each part."""
        for ids, x, u in self.parts(batches):
            keep = _few(ids, x, self.k)
            for t in range(len(self.forest.directions)):
                leaf, n = np.unique(self.forest.leaves(u[keep], t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf), pa.array(n)], ["tree", "leaf", "n"])

    def block(self, t: int, leaf: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cell = leaf >> self.under
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.first[t, cell] + spread % self.chunks[t, cell]

    def homes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, id, near, vector): each row in its block of the first tree, in half precision, and queries' vectors whole."""
        for ids, x, u in self.parts(batches):
            query = ids % self.every == 0
            keep = np.zeros(len(ids), dtype=bool)
            keep[_few(ids, x, self.k)] = True
            keep |= query
            ids, x, u, query = ids[keep], x[keep], u[keep], query[keep]
            vector = pa.array([r.tobytes() if q else None for r, q in zip(x, query.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(self.block(0, self.forest.leaves(u, 0), ids)), pa.array(ids), _rows(u.astype(np.float16)), vector], ["block", "id", "near", "vector"])

    def radii(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as of ``homes``, by block: (id, vector, radius) of the queries."""
        for _, held in _by_block(batches):
            table = pa.Table.from_batches(held)
            vector, ids = table.column("vector").combine_chunks(), table.column("id").to_numpy()
            near = np.frombuffer(b"".join(table.column("near").to_pylist()), dtype=np.float16).reshape(len(table), self.dim).astype(np.float32)
            asks = np.flatnonzero(vector.is_valid().to_numpy(zero_copy_only=False))
            step = max(1, TOGETHER // len(ids))
            radius = np.full(len(asks), 2.0)
            for at in range(0, len(asks), step):
                some = asks[at : at + step]
                c = near[some] @ near.T
                c[ids[some][:, None] == ids[None, :]] = -1.0
                if len(ids) > self.k:
                    best = np.partition(c, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                    radius[at : at + step] = np.sqrt(np.maximum(0.0, 2 - 2 * best)) + 0.01
            yield pa.RecordBatch.from_arrays([pa.array(ids[asks]), vector.take(pa.array(asks)), pa.array(radius)], ["id", "vector", "radius"])

    def indexed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, asks, leaves, id, vector): each row in its block of every tree, with its leaf within the cell."""
        for ids, x, u in self.parts(batches):
            keep = _few(ids, x, self.k)
            ids, x, u = ids[keep], x[keep], u[keep]
            for t in range(len(self.forest.directions)):
                leaf = self.forest.leaves(u, t)
                own = _rows((leaf & ((1 << self.under) - 1)).astype(np.uint16)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(self.block(t, leaf, ids)), pa.array(np.zeros(len(ids), bool)), own, pa.array(ids), _rows(x)], ["block", "asks", "leaves", "id", "vector"])

    def asked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, vector, radius): (block, asks, leaves, id, vector): each query in the blocks of its cells, with a bitmap of their leaves."""
        f, wide = self.forest, 1 << self.under
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                data = part.column(1).to_pylist()
                u = unit(np.frombuffer(b"".join(data), dtype=self.kind).reshape(len(part), self.dim))
                margins = [(u @ f.directions[t].T - f.thresholds[t]).tolist() for t in range(len(f.directions))]
                bounds = (-REACH / np.sqrt(self.dim) * part.column(2).to_numpy()).tolist()
                rows = []
                for k, (i, vector) in enumerate(zip(part.column(0).to_pylist(), data, strict=True)):
                    for t, leaves in enumerate(f.search([m[k] for m in margins], bounds[k], self.sizes)):
                        taken = np.array(leaves, dtype=np.int64)
                        for cell in np.unique(taken >> self.under).tolist():
                            bits = np.zeros(wide, dtype=bool)
                            bits[taken[taken >> self.under == cell] & (wide - 1)] = True
                            bitmap = np.packbits(bits).tobytes()
                            rows += [(block, True, bitmap, i, vector) for block in range(self.first[t, cell], self.first[t, cell] + self.chunks[t, cell])]
                kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["block", "asks", "leaves", "id", "vector"])

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as of ``indexed`` and ``asked``, by block, a block's vectors first: (query_id, vec_id, score), the k best of a block for each of its queries."""
        for block, held in _by_block(batches, "asks"):
            table = pa.Table.from_batches(held)
            asks = table.column("asks").to_numpy()
            ids, x = table.column("id").to_numpy(), np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=self.kind).reshape(len(table), self.dim)
            leaves = table.column("leaves").to_pylist()
            n = int((~asks).sum())
            if not n or n == len(asks):
                continue
            keep = _few(ids[:n], x[:n], self.k)
            own = np.frombuffer(b"".join(leaves[:n]), dtype=np.uint16)[keep]
            order = np.argsort(own, kind="stable")
            own, rows, row_ids = own[order], x[:n][keep][order], ids[:n][keep][order]
            u = unit(rows)
            step = max(1, TOGETHER // len(rows))
            for at in range(n, len(asks), step):
                yield self.best(ids[at : at + step], x[at : at + step], leaves[at : at + step], own, rows, row_ids, u)

    def best(self, asks: np.ndarray, x: np.ndarray, bitmaps: list[bytes], own: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        wanted = np.unpackbits(np.frombuffer(b"".join(bitmaps), dtype=np.uint8).reshape(len(asks), -1), axis=1)[:, : 1 << self.under].astype(bool)
        # leaves that none of these queries wants are not scored
        some = np.flatnonzero(wanted.any(axis=0)[own])
        out: list[tuple] = []
        if len(some):
            c = unit(x) @ u[some].T
            c[~wanted[:, own[some]] | (asks[:, None] == row_ids[some][None, :])] = -np.inf
            m = min(len(some), self.k + SPARE)
            top = np.argpartition(-c, m - 1, axis=1)[:, :m]
            there = np.take_along_axis(c, top, 1) > -np.inf
            q, at = np.nonzero(there)[0], some[top[there]]
            score = cosines(x[q], rows[at])
            order = np.lexsort((row_ids[at], -score, q))
            q, at, score = q[order], at[order], score[order]
            first = (np.arange(len(q)) - np.searchsorted(q, q)) < self.k
            out = [asks[q[first]], row_ids[at[first]], score[first]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out or [[], [], []], (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def _by_block(batches: Iterator[pa.RecordBatch], asks: str | None = None) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(block, its rows) of rows sorted by block. With ``asks``, a block comes again for each ten thousand or so of its queries."""
    now, held, queries, size = None, [], [], 0
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if block[x] != now:
                if held or queries:
                    yield now, held + queries
                now, held, queries, size = block[x], [], [], 0
            part = batch.slice(x, y - x)
            if asks is None:
                held.append(part)
                continue
            rest = int((~part.column(asks).to_numpy(zero_copy_only=False)).sum())
            if rest:
                held.append(part.slice(0, rest))
            if rest < len(part):
                queries.append(part.slice(rest))
                size += len(part) - rest
                if size >= 10_000:
                    yield now, held + queries
                    queries, size = [], 0
    if held or queries:
        yield now, held + queries


def clean(table: DataFrame) -> DataFrame:
    """(id, x): the rows that take part."""
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    x = F.col("embedding").cast(f"array<{kind}>")
    rows = table.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(finite & F.exists("x", lambda v: v != 0))


def neighbours(table: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row of ``table`` (vec_id, embedding) whose vec_id ``every`` divides.

    Nearness is the cosine in double precision, ties go to the smaller vec_id; a row is not its own neighbour. Rows with a null vec_id or
    vector, with a null or non-finite component, or all zeros take no part, nor do those whose length is not the most frequent one (of
    several the greatest). Rows that repeat a vec_id count once, with the least of their vectors. Where there are fewer than ``k`` others,
    all of them are given. A table without queries gives an empty one. Recall depends on the data and is held against brute force by tests; equal
    vectors are always found together.
    """
    spark = table.sparkSession
    rows = clean(table)
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = most["dim"], most["n"]
    rows = rows.filter(F.size("x") == dim)
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        rows = written(rows.groupBy("id").agg(F.min("x").alias("x")))
    kind = np.float32 if rows.schema["x"].dataType.elementType.simpleString() == "float" else np.float64
    limit = max(2, min(SAMPLE, NUMBERS // dim))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(limit).select("x").toArrow()
    index = _Index(fit(_matrix(sample.column(0).combine_chunks(), dim, kind), n, trees), dim, kind, k, every)
    # a row a tree and leaf: at most trees * SAMPLE / IN_LEAF of them
    counts = rows.mapInArrow(index.counted, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    held = np.zeros((trees, 1 << index.forest.depth), dtype=np.int64)
    for r in counts:
        held[r["tree"], r["leaf"]] = r["n"]
    index.sizes = held.tolist()
    index.chunks = np.maximum(1, -(-held.reshape(trees, index.cells, -1).sum(axis=2) // BLOCK))
    index.first = (np.cumsum(index.chunks.ravel()) - index.chunks.ravel()).reshape(trees, index.cells)
    blocks = int(index.chunks.sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 10_000))
    homes = rows.mapInArrow(index.homes, "block long, id long, near binary, vector binary")
    queries = written(homes.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(index.radii, "id long, vector binary, radius double"))
    form = "block long, asks boolean, leaves binary, id long, vector binary"
    both = rows.mapInArrow(index.indexed, form).union(queries.repartition(parts, "id").mapInArrow(index.asked, form))
    found = both.repartition(parts, "block").sortWithinPartitions("block", "asks", "leaves").mapInArrow(index.scored, "query_id long, vec_id long, score double")
    found = written(found).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
