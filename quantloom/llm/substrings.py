"""Exact substring deduplication with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. The suffixes of all texts would have to be sorted to a
depth of LENGTH only, so the difference-cover construction is cut there, and what is unique drops out at each level:

1. Sample. D is a difference cover modulo V: for any two positions i and j there is a k < V with i+k and j+k both at residues in D.
   Each sampled position is named by its first LENGTH - V + 1 bytes, the V-fold of the classical triples. Names are sorted, each range
   of names by one task, and those that occur once are dropped: no repeated string has its sampled position there.
2. Recurse and merge. A suffix, sampled or not, starts a repeated string only if a name repeats at one of its next sampled positions.
   All such suffixes are named by LENGTH bytes and sorted together; equal neighbours are the strings that start twice.

Names are hashes of the strings: at the first level 32 bits within a range, which may only let more through, then 64 bits within a
range. As a range is of bounded size, wrongly equal names grow with the corpus, not with its square: less than one in a hundred runs
over 30 GB. Texts are packed in blocks, written once to the shared folder in buckets of their own, and hashed there again at each
level, so that names and bits are shuffled, but no text. Texts that are wholly equal take part once, as all of their bytes go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, cut, discard, mix, powers, running, seeds, shared_dir, window_hashes, written

LENGTH = 200
#: A perfect difference set modulo 133: each difference occurs once.
V, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: Bytes of text in a block, and of all texts whose names one task sorts.
BLOCK, RANGE = 4 << 20, 48 << 20
#: Texts of a batch that a task takes out at once.
TEXTS = 64
_COVERED = np.zeros(V, dtype=bool)
_COVERED[list(COVER)] = True
_SECOND = seeds(256, 77_000)


def _bucket(block: int, count: int) -> int:
    """The bucket that Spark puts a long in: Murmur3 with seed 42."""
    m = 0xFFFFFFFF
    h = 42
    for k in (block & m, (block >> 32) & m):
        k = k * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        h = (h << 13 | h >> 19) & m
        h = (h * 5 + 0xE6546B64) & m
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & m
    return (h - (1 << 32) if h >> 31 else h) % count


def _packed(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text): blocks, of texts of ``least`` bytes and more in one string; shorter and repeated ones by length and digest only."""
        part, n, seen = TaskContext.get().partitionId(), 0, set()

        def free(n: int) -> int:
            """The next number whose block falls into the task's bucket, so that a task writes one file and nothing is shuffled."""
            while _bucket((part << 32) + n, buckets) != part % buckets:
                n += 1
            return n

        n = free(0)
        ids, sizes, digests, held, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            row = [(part << 32) + n, ids, sizes, digests, [len(h) for h in held], b"".join(held)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.large_binary() if size > 1 << 30 else pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["block", "ids", "sizes", "digests", "held", "data"])

        for batch in batches:
            # as bytes, a few at a time: a batch holds texts of 64 MB, of which strings take up to four times as much
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            for at in range(0, len(batch), TEXTS):
                for doc, data in zip(batch.column(0).slice(at, TEXTS).to_pylist(), texts.slice(at, TEXTS).to_pylist(), strict=True):
                    data = data or b""
                    digest = hashlib.sha256(data).digest()
                    ids.append(doc)
                    sizes.append(len(data))
                    digests.append(digest)
                    if len(data) >= least and digest not in seen:
                        seen.add(digest)
                        held.append(data)
                        size += len(data)
                    else:
                        held.append(b"")
                    if size >= BLOCK or len(ids) >= 20_000:
                        yield block()
                        n, size = free(n + 1), 0
                        ids, sizes, digests, held = [], [], [], []
        if ids:
            yield block()

    return run


def _texts(held: list[int], data: bytes, out: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the block, bytes) of the texts that take part."""
    at = 0
    view = np.frombuffer(data, dtype=np.uint8)
    for k, n in enumerate(held):
        if n and k not in out:
            yield k, view[at : at + n]
        at += n


def _sampled(n: int, depth: int) -> np.ndarray:
    at = np.arange(max(0, n - depth + 1))
    return at[_COVERED[at % V]]


class _Ranges:
    """Deals names to ranges, and gives back which of them repeat. ``kind``: of a name within its range."""

    def __init__(self, count: int, kind: type) -> None:
        self.count, self.kind = count, kind

    def dealt(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, places, names) of each range: ``a`` chooses the range, ``b`` is the name. Nothing for no names."""
        if not len(a):
            return
        where = ((a >> U(32)) * U(self.count) >> U(32)).astype(np.uint16 if self.count < 1 << 16 else np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order].astype(np.int64), prepend=-1))
        names = b[order].astype(self.kind)
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
            yield int(where[order[x]]), order[x:y], names[x:y]

    def sent(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(range, distinct names in order, bits of those that the block has twice)."""
        for where, _, names in self.dealt(a, b):
            each, n = np.unique(names, return_counts=True)
            yield where, each.tobytes(), np.packbits(n > 1).tobytes()

    def hits(self, a: np.ndarray, b: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
        """For each name whether it repeats, from the bits that came back for what ``sent`` gave."""
        out = np.zeros(len(a), dtype=bool)
        for where, places, names in self.dealt(a, b):
            each, back = np.unique(names, return_inverse=True)
            out[places] = np.unpackbits(np.frombuffer(bits[where], dtype=np.uint8), count=len(each)).astype(bool)[back]
        return out


def _repeated(kind: type):
    def answers(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        names = [np.frombuffer(r[2], dtype=kind) for r in rows]
        every = np.sort(np.concatenate(names))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for x, r in zip(names, rows, strict=True):
            hit = np.unpackbits(np.frombuffer(r[3], dtype=np.uint8), count=len(x)).astype(bool)
            if len(twice):
                hit |= twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x
            out.append(np.packbits(hit).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(out, pa.binary())], ["block", "place", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (place, block, names, twice), sorted by place: for each the bits of the names that occur twice in the range."""
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield answers(held)
                    held = []
                held.append(row)
        if held:
            yield answers(held)

    return run


class _Level:
    """Reads blocks (block, held, data; copied_at: texts that stand in several rows, first_at: those of them that take part; one, two: the bits of the levels before) at one level."""

    def __init__(self, length: int, level: int, one: _Ranges, two: _Ranges) -> None:
        self.length, self.level, self.one, self.two = length, level, one, two

    def sampled(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The sampled positions of each text, and all their names."""
        depth = self.length - V + 1
        at = [_sampled(len(t), depth) for t in texts]
        names = [window_hashes(running(t), a, depth) for t, a in zip(texts, at, strict=True)]
        return at, np.concatenate(names) if names else np.zeros(0, U)

    def left(self, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The positions of ``t`` that may start a repeated string, by the sampled ones with repeated names."""
        n = len(t) - self.length + 1
        edge = np.bincount(np.clip(at - (V - 1), 0, n), minlength=n + 1) - np.bincount(np.clip(at + 1, 0, n), minlength=n + 1)
        return np.flatnonzero(np.cumsum(edge[:n]) > 0)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                with np.errstate(over="ignore"):
                    yield self.block(batch.slice(k, 1).to_pylist()[0])

    def block(self, row: dict) -> pa.RecordBatch:
        copied = set(row["copied_at"] or ())
        out = copied - set(row["first_at"] or ())
        pairs = list(_texts(row["held"], row["data"], out))
        texts = [t for _, t in pairs]
        at, names = self.sampled(texts)
        if self.level == 1:
            return self.message(row["block"], list(self.one.sent(names, mix(names))))
        hit = self.one.hits(names, mix(names), {x["place"]: x["bits"] for x in row["one"] or []})
        ends = np.cumsum([len(x) for x in at])
        starts = [self.left(t, x[hit[e - len(x) : e]]) for t, x, e in zip(texts, at, ends.tolist(), strict=True)]
        a, b = np.zeros(0, U), np.zeros(0, U)
        if texts:
            a = np.concatenate([window_hashes(running(t), x, self.length) for t, x in zip(texts, starts, strict=True)])
            b = np.concatenate([window_hashes(running(t, _SECOND), x, self.length) for t, x in zip(texts, starts, strict=True)])
        if self.level == 2:
            return self.message(row["block"], list(self.two.sent(a, b)))
        hit = self.two.hits(a, b, {x["place"]: x["bits"] for x in row["two"] or []})
        ends = np.cumsum([len(x) for x in starts])
        return self.result(row, copied, [p for p, _ in pairs], texts, [x[hit[e - len(x) : e]] for x, e in zip(starts, ends.tolist(), strict=True)])

    @staticmethod
    def message(block: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["place", "block", "names", "twice"])

    def result(self, row: dict, copied: set[int], places: list[int], texts: list[np.ndarray], starts: list[np.ndarray]) -> pa.RecordBatch:
        """A row a text: what goes, and what remains."""
        removed, spans, kept, cuts = {}, {}, {}, {}
        for p, t, s in zip(places, texts, starts, strict=True):
            edge = np.zeros(len(t) + 1, dtype=np.int32)
            edge[s] += 1
            edge[s + self.length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.diff(gone.view(np.int8), prepend=0, append=0)
            a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            removed[p], spans[p] = int(gone.sum()), len(a)
            kept[p] = t[~gone].tobytes()
            cuts[p] = ",".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True))
        n = range(len(row["ids"]))
        of = {p: hashlib.sha256(kept[p]).hexdigest() for p in places}
        empty = hashlib.sha256(b"").hexdigest()
        at, ids, sizes, out = 0, row["ids"], row["sizes"], []
        for k in n:
            if k in copied:  # an equal text stands elsewhere: every byte goes
                out.append((ids[k], sizes[k], sizes[k], 1, empty, f"0:{sizes[k]}"))
            elif k in of:
                out.append((ids[k], sizes[k], removed[k], spans[k], of[k], cuts[k]))
            else:  # too short for any such string
                out.append((ids[k], sizes[k], 0, 0, row["digests"][k].hex(), ""))
            at += row["held"][k]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def pack(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int, Callable[[], None]]:
    """The texts in blocks, with copied_at and first_at; the copies (block, k, digest, first); how many ranges names are dealt to; and what removes the blocks.

    Blocks (block, ids, sizes, digests, held, data, copied_at, first_at) are written once to the shared folder, bucketed by block.
    Of texts of ``least`` bytes or more that stand in several rows, one, at first_at, takes part; copied_at has all of them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    packed = texts.mapInArrow(_packed(least, buckets), "block long, ids array<long>, sizes array<long>, digests array<binary>, held array<long>, data binary")
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    packed.write.option("path", path).option("compression", "zstd").option("parquet.block.size", 16 << 20).bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.agg(F.sum(F.expr("aggregate(held, 0L, (a, x) -> a + x)"))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "sizes", "digests", "held")).alias("k", "x")).filter(F.col("x.sizes") >= least)
    rows = rows.select("block", "k", F.col("x.ids").alias("doc_id"), F.col("x.digests").alias("digest"), (F.col("x.held") > 0).alias("held"))
    classes = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("held"), F.struct("block", "k", "doc_id"))).alias("of")).filter("n > 1")
    is_first = (F.col("block") == F.col("of.block")) & (F.col("k") == F.col("of.k"))
    copies = cut(rows.join(classes, "digest").select("block", "k", "doc_id", F.col("of.doc_id").alias("first_id"), is_first.alias("first")))
    marks = copies.groupBy("block").agg(F.collect_list("k").alias("copied_at"), F.collect_list(F.when(F.col("first"), F.col("k"))).alias("first_at"))
    return blocks.join(cut(marks), "block", "left"), copies, count, lambda: discard(spark, path, name)


def answered(sent: DataFrame, count: int, kind: type) -> DataFrame:
    """(block, bits): for each block what came back for the names that it has sent (place, block, names, twice)."""
    back = sent.repartition(count, "place").sortWithinPartitions("place").mapInArrow(_repeated(kind), "block long, place long, bits binary")
    return cut(back.groupBy("block").agg(F.collect_list(F.struct("place", "bits")).alias("bits")))


def repeated_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs`` (doc_id, text; no other column is read).

    Texts are UTF-8 bytes, a null one is empty. A byte goes if it is covered by a string of ``length`` bytes (V or more) that also starts
    anywhere else, in another row or the same. spans are start:end of the maximal runs that go. Rows that repeat lose everything, if
    they are long enough; a row shorter than ``length`` loses nothing; an empty table gives an empty one; null ids are kept.
    """
    if length < V:
        raise ValueError(f"length has to be {V} or more")
    state, _, count, remove = pack(docs, length)
    ranges = (_Ranges(count, np.uint32), _Ranges(count, U))
    now = state.select("block", "held", "data", "copied_at", "first_at")
    for level, into in ((1, "one"), (2, "two")):
        sent = now.mapInArrow(_Level(length, level, *ranges), "place long, block long, names binary, twice binary")
        state = state.join(answered(sent, count, ranges[level - 1].kind).withColumnRenamed("bits", into), "block", "left")
        now = state.select("block", "held", "data", "copied_at", "first_at", "one")
    now = state.select("block", "ids", "sizes", "digests", "held", "data", "copied_at", "first_at", "one", "two")
    found = written(now.mapInArrow(_Level(length, 3, *ranges), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"))
    remove()
    return found
