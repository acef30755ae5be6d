"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures.

A document's set is its distinct five-word shingles, as 64-bit hashes. Its signature has 64 positions, each the low 16 bits of a
minimum under one hash function; two positions agree with a probability that is the sets' Jaccard similarity. At a similarity of
0.75 the number of positions that differ has mean 16 and deviation 3.5, so signatures are joined up to a distance of 31, and
about one such pair in 50,000 lies beyond it. By the pigeonhole principle two signatures that differ in at most 31 of 64
positions differ in at most one position of some of the 16 chunks of four; the chunk's allowed error is enumerated by leaving
out each of its positions in turn, so every pair under the distance shares one of 64 keys.

A bucket is never expanded into its pairs. First each member is held against the bucket's least member, on full sets; that joins
groups of copies of any size. Only buckets whose members then lie in different components are looked at again. Components with
signatures within the distance get a common name, and all documents of one name are compared on full sets, by blocks, as a product
of indicator matrices. Both steps give forests of links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, cut, fresh, mix, seeds, shingle_hashes, word_hashes
from .components import connected_components, star_components

WIDTH, SHARE = 5, (75, 100)
POSITIONS, CHUNK, DISTANCE = 64, 4, 31
#: Members of one star that one task compares with its centre.
STAR = 256
#: Signatures of a bucket, and texts of components that may be linked, that one task compares with each other or with as many others.
BLOCK, TOGETHER = 2048, 512
#: Shingles of such texts, which bounds a task's memory where texts are long.
MOST_SHINGLES = 1 << 18
_A, _B = seeds(POSITIONS, 1000) | U(1), seeds(POSITIONS, 5000)

SIGNED = "doc_id long, n_shingles long, node long, signature binary"


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    for words in word_hashes([(t or "").encode() for t in texts]):
        yield np.unique(shingle_hashes(words, width))


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 numbers of 16 bits."""
    least = np.full(POSITIONS, np.iinfo(U).max, dtype=U)
    for at in range(0, len(shingles), 4096):
        x = np.multiply.outer(_A, shingles[at : at + 4096])
        x += _B[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return (mix(least) >> U(48)).astype(np.uint16)


def node_of(shingles: np.ndarray) -> int | None:
    """A set's 64-bit hash."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        return int(mix(mix(shingles ^ U(len(shingles))).sum(dtype=U, keepdims=True)).view(np.int64)[0])


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                n, node, sig = [], [], []
                with np.errstate(over="ignore"):
                    for s in shingle_sets(part.column(1).to_pylist(), width):
                        n.append(len(s))
                        node.append(node_of(s))
                        sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "node", "signature"])

    return run


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, node, signature): node is a 64-bit hash of the set, the same for equal sets; null, as the signature, for an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signed(width), SIGNED)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = POSITIONS // CHUNK
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, chunks, CHUNK).astype(np.int64)
            out = np.empty((len(sig), chunks, CHUNK), dtype=np.int64)
            for j in range(CHUNK):
                a, b, c = (k for k in range(CHUNK) if k != j)
                out[:, :, j] = (np.arange(chunks) * CHUNK + j) << 48 | sig[:, :, a] << 32 | sig[:, :, b] << 16 | sig[:, :, c]
            node = np.repeat(part.column(0).to_numpy(), chunks * CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)), pa.array(node)], ["key", "node"])


class _Union:
    """Joins labels; ``root`` follows them."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self, xs: np.ndarray) -> np.ndarray:
        each, back = np.unique(xs, return_inverse=True)
        return np.array([self.root(x) for x in each.tolist()], dtype=np.int64)[back]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["rep", "member"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, node, component, signature), sorted by the first three. Pairs of components that are within the
    distance, as a forest: what earlier pairs of the batch have joined is not joined again."""

    def joined(rows: list[tuple]) -> list[tuple[int, int]]:
        found, union = [], _Union()
        key, i, j, block = (np.array([r[k] for r in rows]) for k in range(4))
        comp = np.array([r[5] for r in rows])
        sig = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint16).reshape(len(rows), POSITIONS)
        new = np.append(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(rows))
        left = np.repeat(new, np.diff(new, prepend=0)) - np.arange(len(rows))  # rows to the end of the own group
        now = comp.copy()
        live, step = np.flatnonzero(left > 1), 1
        while len(live):
            other = live + step
            at = live[(now[live] != now[other]) & ((i[live] == j[live]) | (block[live] != block[other]))]
            merged = False
            for k in range(0, len(at), 65536):
                part = at[k : k + 65536]
                for x in part[(sig[part] != sig[part + step]).sum(axis=1) <= DISTANCE].tolist():
                    if union.join(int(comp[x]), int(comp[x + step])):
                        found.append((int(comp[x]), int(comp[x + step])))
                        merged = True
            if merged:
                now = union.roots(comp)
            step += 1
            live = live[left[live] > step]
        return found

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if len(held) >= 8192:
            last = held[-1][:3]
            at = len(held)
            while at and held[at - 1][:3] == last:
                at -= 1
            if at:
                yield _pairs(joined(held[:at]))
                held = held[at:]
    if held:
        yield _pairs(joined(held))


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, from a product of indicator matrices, a stretch of elements at a time."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = counts[ids] > 1
    rank = np.cumsum(counts > 1) - 1
    ids, owner = rank[ids[use]], owner[use]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):
        a, b = np.searchsorted(ids, [at, at + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owner[a:b], ids[a:b] - at] = 1
        out += part @ part.T
    return out


def _resolved(width: int, share: tuple[int, int]):
    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        union, sets = _Union(), []
        rows = [(r, s) for r, s in zip(rows, shingle_sets([r[6] for r in rows], width), strict=True) if node_of(s) == r[4]]
        if not rows:
            return []
        sets = [s for _, s in rows]
        i, j, block = rows[0][0][1], rows[0][0][2], np.array([r[3] for r, _ in rows])
        comp, n = np.array([r[5] for r, _ in rows]), np.array([len(s) for s in sets])
        both = shared(sets)
        found = []
        for x in range(len(rows)):
            near = share[1] * both[x] >= share[0] * (n[x] + n - both[x])
            near[: x + 1] = False
            near &= comp != comp[x]
            if i != j:
                near &= block != block[x]
            for y in np.flatnonzero(near).tolist():
                if union.join(int(comp[x]), int(comp[y])):
                    found.append((rows[x][0][4], rows[y][0][4]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (close, i, j, block, node, component, text), sorted by the first three: the links of different components, as a forest."""
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield _pairs(links(held))
                    held = []
                held.append(row)
        if held:
            yield _pairs(links(held))

    return run


def _in_blocks(df: DataFrame) -> DataFrame:
    """``df`` (node, blocks) with block, i and j: a copy of each row for every pair of blocks with its own."""
    return (
        df.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    )


def _confirmed(width: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (rep, salt, node, follows, text), sorted so that a star's centre comes first."""
        star, centre = None, np.zeros(0, dtype=U)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rep, salt, node, follows = (part.column(k).to_pylist() for k in range(4))
                a, b = [], []
                for r, s, n, f, x in zip(rep, salt, node, follows, shingle_sets(part.column(4).to_pylist(), width), strict=True):
                    if node_of(x) != n:  # another row of the same doc_id
                        continue
                    if not f:
                        star, centre = (r, s), x
                    elif star == (r, s):
                        both = len(np.intersect1d(centre, x, assume_unique=True))
                        if share[1] * both >= share[0] * (len(centre) + len(x) - both):
                            a.append(r)
                            b.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["rep", "member"])

    return run


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """Those of ``pairs`` (rep, member) of ``nodes`` (node, doc_id) that are near on the full sets of ``docs``.

    A star of any size is dealt to tasks in parts of about STAR members, each with a copy of its centre's text.
    """
    # written first: then the join by rep has no aggregation in its stage, and Spark may split a star with very many members
    sizes = cut(pairs.groupBy("rep").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")))
    members = pairs.join(sizes, "rep").select("rep", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("salt"), F.col("member").alias("node"), F.lit(True).alias("follows"))
    centres = sizes.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("rep").alias("node"), F.lit(False).alias("follows"))
    rows = members.union(centres).join(nodes.select("node", F.col("doc_id").alias("owner")), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(texts, F.col("owner").eqNullSafe(F.col("doc_id"))).select("rep", "salt", "node", "follows", "text")
    dealt = rows.repartition("rep", "salt").sortWithinPartitions("rep", "salt", "follows", "node")
    return dealt.mapInArrow(_confirmed(width, share), "rep long, member long").distinct()


def _classes(docs: DataFrame, width: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``signatures`` of all rows, and (node, doc_id, component) of their nodes, with the least doc_id of each."""
    signed = cut(signatures(docs, width))
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    nodes = cut(nodes)
    keyed = nodes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    keys = cut(keyed.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1"))
    buckets = cut(keyed.join(keys, "key").filter("rep <> node").select("key", "rep", F.col("node").alias("member")))
    stars = cut(buckets.select("rep", "member").distinct())
    sure = cut(confirm(stars, nodes, docs, width, share))
    comp = cut(star_components(sure))
    # what remains: buckets that hold more than one component
    of = lambda name: comp.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    split = (
        stars.join(of("rep"), "rep", "left").join(of("member"), "member", "left")
        .withColumn("rep_c", F.coalesce("rep_c", "rep")).withColumn("member_c", F.coalesce("member_c", "member"))
    )
    open_ = buckets.join(split.filter("rep_c <> member_c").select("rep", "member"), ["rep", "member"], "left_semi").select("key").distinct()
    open_ = cut(open_.join(keys, "key").select("key", "rep", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    left = buckets.join(open_.select("key", "blocks"), "key").select("key", F.col("member").alias("node"), "blocks").union(open_.select("key", F.col("rep").alias("node"), "blocks"))
    left = _in_blocks(left).join(nodes.select("node", "signature"), "node").join(comp, "node", "left")
    left = left.select("key", "i", "j", "block", "node", F.coalesce("component", "node").alias("component"), "signature")
    close = left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "node").mapInArrow(_close, "rep long, member long")
    close = cut(close.distinct())
    if not close.isEmpty():
        # components that may be linked, by a name that they share; all their nodes are compared on full sets, by blocks of bounded size
        name = cut(connected_components(close.select(F.col("rep").alias("u"), F.col("member").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("close")))
        held = nodes.select("node", F.col("doc_id").alias("owner"), "n_shingles").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).join(name, "component")
        held = cut(held)
        sizes = held.groupBy("close").agg(F.greatest(F.ceil(F.count("*") / TOGETHER), F.ceil(F.sum("n_shingles") / MOST_SHINGLES)).cast("int").alias("blocks"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        held = _in_blocks(held.join(cut(sizes), "close")).join(texts, F.col("owner").eqNullSafe(F.col("doc_id"))).select("close", "i", "j", "block", "node", "component", "text")
        more = held.repartition("close", "i", "j").sortWithinPartitions("close", "i", "j", "block", "node").mapInArrow(_resolved(width, share), "rep long, member long")
        comp = cut(star_components(sure.union(cut(more.distinct()))))
    return signed, cut(nodes.select("node", "doc_id").join(comp, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are not read).

    Words are the runs of other characters than space and \\t..\\r, with A-Z as a-z. Documents are linked when
    share[1] * |A & B| >= share[0] * |A | B|; component_id is the least doc_id that can be reached, kept whether it is the own one.

    A null text is an empty one; an empty set is linked with nothing. Rows that repeat a doc_id with an equal set get the same
    answer, and stay or go together. A row without doc_id takes part, and is not kept if its component has a doc_id; alone, its
    component_id is null and it is kept. An empty table gives an empty one. Shares under 0.75 need another DISTANCE.
    """
    signed, ids = _classes(docs, width, share)
    least = cut(ids.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    ids = ids.join(least, "component").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of near-duplicates, with all their columns.

    The row with the least doc_id stays; of several rows with that id, those of one set, and of these one. A group of which no row has a
    doc_id keeps one row too. A row without words is in no group, and stays. An empty table gives an empty one.
    """
    from .pieces import _added

    def node(texts: list[str | None]) -> list[pa.Array]:
        with np.errstate(over="ignore"):
            return [pa.array([node_of(s) for s in shingle_sets(texts, width)], pa.int64())]

    _, ids = _classes(docs, width, share)
    no_id, id_, node_, kept_, alone, text = (fresh(docs, f"_q_{n}") for n in ("no_id", "id", "node", "kept", "alone", "text"))
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "node")).alias("x"))
    first = cut(first.select(F.col("x.no_id").alias(no_id), F.col("x.id").alias(id_), F.col("x.node").alias(node_), F.lit(True).alias(kept_)))
    rows = _added(docs.withColumn(text, F.col("text").cast("string")), f"{node_} long", text, node)
    # rows are dealt by id and set, so that copies are not dealt to one task; those without a set have each a number of their own
    rows = rows.withColumns({
        no_id: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        alone: F.col(node_).isNull(), node_: F.coalesce(node_, F.monotonically_increasing_id()),
    })
    on = [no_id, id_, node_]
    kept = rows.join(first, on, "left").filter(f"{alone} or {kept_}")
    return kept.dropDuplicates([*on, alone]).select(*docs.columns)
