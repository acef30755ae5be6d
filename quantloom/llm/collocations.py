"""Phrase collocations: frequent phrases of up to four words by bounded suffix automata, one a shard, reduced globally.

Texts are packed in shards of one language, as a dictionary and the places of its words, and written once. An automaton of a shard has
the substrings of up to DEPTH words of its pieces as states: substrings that end at the same places are one state, which knows its
longest and shortest one, the number of its end places, and by its suffix link the state of the longest shorter suffix that ends at
more places. States are built a depth at a time, from the two overlapping states one word shorter, on whole arrays.

A phrase is frequent only if its parts are, so each depth goes as far as the one before says: a shard sends the names and counts of its
substrings of one depth, by ranges of names, and gets back a bit for each that is frequent over all shards. Names are 32-bit hashes
within a range, so a bit may let a rare phrase through, and never stops a frequent one. What is left after DEPTH rounds is sent as
states, (longest substring, shortest length, count), is spread into substrings along the links, and is counted exactly by its text.

What subsumes a phrase is looked for along the links as well: counts only fall as phrases grow, so the most frequent longer phrase
around a phrase is one word longer, and has it as its suffix or its head.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _FOLDED, U, _hash_words, cut, discard, mix, seeds, shared_dir, written
from .substrings import _bucket, _Ranges

DEPTH, LEAST, TOP = 4, 30, 2000
#: A longer phrase with so many hundredths of a phrase's count stands for it.
COVER = 80
#: Bytes of text in a shard, and of names that one task sorts.
SHARD, RANGE = 4 << 20, 32 << 20
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK, _APART = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_APART[list(BREAKS + GAPS)] = True
_HEAD, _TAIL = seeds(2, 55_000)


def tokenized(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of ``data`` with A-Z as a-z; for each word in turn its place among them; and whether it is the first of its piece.

    Words are told apart by 64-bit hashes within the shard.
    """
    with np.errstate(over="ignore"):
        starts, hashes = _hash_words(data, _FOLDED, _APART)
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    view = np.frombuffer(data, dtype=np.uint8)
    apart = np.append(np.flatnonzero(_APART[view]), len(data))
    low = data.lower()
    a = starts[first]
    words = [low[x:y] for x, y in zip(a.tolist(), apart[np.searchsorted(apart, a)].tolist(), strict=True)]
    piece = np.searchsorted(np.flatnonzero(_BREAK[view]), starts)
    return words, ids.astype(np.int32), np.diff(piece, prepend=-1) != 0


def _shards(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (lang, text): shards of one language each."""
        part, n = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0

        def shard(lang: str) -> pa.RecordBatch:
            # a number that falls into the task's own bucket, so that shards are written where they are
            nonlocal n, total
            while _bucket((part << 32) + n, buckets) != part % buckets:
                n += 1
            words, ids, first = tokenized(b"\n".join(held.pop(lang)))
            total -= sizes.pop(lang)
            row = [(part << 32) + n, lang, len(ids), b" ".join(words), ids.tobytes(), np.packbits(first).tobytes()]
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "lang", "n", "words", "ids", "first"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(text or b"") + 1
                held.setdefault(lang, []).append(text or b"")
                sizes[lang] = sizes.get(lang, 0) + size
                total += size
                if sizes[lang] >= most:
                    yield shard(lang)
                elif total >= 2 * most:
                    yield shard(max(sizes, key=sizes.get))
        for lang in list(held):
            yield shard(lang)

    return run


class Automaton:
    """The states of a shard, a depth at a time.

    ``at``: for each word the substring of the last depth that ends there, -1 if there is none. For each depth, ``names``, ``counts``
    (of end places), ``heads`` and ``tails`` (the substrings without the last and without the first word, one depth down).
    """

    def __init__(self, words: bytes, ids: np.ndarray, first: np.ndarray, lang: str) -> None:
        self.words = words.split(b" ") if words else []
        self.first, self.at = first, ids.astype(np.int64)
        _, hashes = _hash_words(words, _FOLDED, _APART)
        salt = _hash_words(b"=" + lang.encode().replace(b" ", b"_"), _FOLDED, _APART)[1]
        self.names = [mix(hashes ^ salt.sum(dtype=U))]
        self.counts = [np.bincount(self.at, minlength=len(self.words))]
        self.heads: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.tails: list[np.ndarray] = [np.zeros(0, np.int64)]

    def keep(self, alive: np.ndarray) -> None:
        """Only the substrings of the last depth that ``alive`` says are gone on from."""
        self.at = np.where((self.at >= 0) & alive[self.at], self.at, -1) if len(alive) else self.at
        self.alive = alive

    def grow(self) -> None:
        """One word more: what ends at a word is made of what ended at the word before and of what ends there."""
        size = max(1, len(self.counts[-1]))
        ends = np.flatnonzero((self.at[1:] >= 0) & (self.at[:-1] >= 0) & ~self.first[1:]) + 1 if len(self.at) else np.zeros(0, np.int64)
        keys, back, counts = np.unique(self.at[ends - 1] * size + self.at[ends], return_inverse=True, return_counts=True)
        self.at = np.full(len(self.at), -1, dtype=np.int64)
        self.at[ends] = back
        heads, tails = keys // size, keys % size
        names = self.names[-1]
        self.names.append(mix(names[heads] * _HEAD + names[tails] * _TAIL))
        self.counts.append(counts)
        self.heads.append(heads)
        self.tails.append(tails)

    def states(self, alive: list[np.ndarray]) -> Iterator[tuple[bytes, int, int]]:
        """(longest substring, the length of its shortest, count) of each state of the substrings that are ``alive``, depth by depth."""
        longer = np.zeros(0, dtype=bool)
        texts: list[list[bytes]] = []
        for d, counts in enumerate(self.counts):
            texts.append(self.words if not d else [b"%b %b" % (texts[-1][h], self.words[w]) for h, w in zip(self.heads[d].tolist(), self._last(d).tolist(), strict=True)])
        shortest = [np.ones(len(self.counts[0]), dtype=np.int64)]
        for d in range(1, len(self.counts)):
            # a substring is in one state with its suffix if both end at the same places: the link then starts further down
            same = self.counts[d - 1][self.tails[d]] == self.counts[d]
            shortest.append(np.where(same & alive[d - 1][self.tails[d]], shortest[d - 1][self.tails[d]], d + 1))
        for d, counts in enumerate(self.counts):
            longer = np.zeros(len(counts), dtype=bool)
            if d + 1 < len(self.counts):
                up = alive[d + 1]
                of = self.tails[d + 1][up]
                longer[of[self.counts[d + 1][up] == counts[of]]] = True
            for k in np.flatnonzero(alive[d] & ~longer).tolist():
                yield texts[d][k], int(shortest[d][k]), int(counts[k])

    def _last(self, d: int) -> np.ndarray:
        """The last word of each substring of depth ``d`` (from 0)."""
        out = self.tails[d]
        for k in range(d - 1, 0, -1):
            out = self.tails[k][out]
        return out


def _kind(least: int) -> type:
    """Of the counts that are sent: no bound on them is under ``least``."""
    return np.uint8 if least <= 255 else np.uint32


def _sent(ranges: _Ranges, names: np.ndarray, counts: np.ndarray, kind: type) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, names in order, their counts, up to the greatest of ``kind``). Differences of names are sent plane by plane, as they compress so."""
    for where, places, mine in ranges.dealt(names, mix(names)):
        each, back = np.unique(mine, return_inverse=True)
        total = np.minimum(np.bincount(back, weights=counts[places]), np.iinfo(kind).max).astype(kind)
        yield where, np.diff(each, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), total.tobytes()


def _hits(ranges: _Ranges, names: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """For each name whether it is frequent, from the bits that came back for what ``_sent`` gave."""
    out = np.zeros(len(names), dtype=bool)
    for where, places, mine in ranges.dealt(names, mix(names)):
        each, back = np.unique(mine, return_inverse=True)
        out[places] = np.unpackbits(np.frombuffer(bits[where], dtype=np.uint8), count=len(each)).astype(bool)[back]
    return out


def _frequent(least: int):
    def answers(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        names = [np.cumsum(np.frombuffer(r[2], dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32) for r in rows]
        every, back = np.unique(np.concatenate(names), return_inverse=True)
        often = np.bincount(back, weights=np.concatenate([np.frombuffer(r[3], dtype=_kind(least)) for r in rows]), minlength=len(every)) >= least
        ends = np.cumsum([len(x) for x in names])
        out = [np.packbits(often[back[e - len(x) : e]]).tobytes() for x, e in zip(names, ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(out, pa.binary())], ["shard", "place", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (place, shard, names, counts), sorted by place: for each the bits of the names whose counts reach ``least`` in the range."""
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


class _Depth:
    """Reads shards, with the bits of the depths before as b1, b2, ...: sends the names of a depth, or the states after the last."""

    def __init__(self, depth: int, ranges: _Ranges, kind: type, last: bool) -> None:
        self.depth, self.ranges, self.kind, self.last = depth, ranges, kind, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                with np.errstate(over="ignore"):
                    yield self.shard(batch.slice(k, 1).to_pylist()[0])

    def shard(self, row: dict) -> pa.RecordBatch:
        ids = np.frombuffer(row["ids"], dtype=np.int32)
        a = Automaton(row["words"], ids, np.unpackbits(np.frombuffer(row["first"], dtype=np.uint8), count=len(ids)).astype(bool), row["lang"])
        alive = []
        for d in range(1, self.depth + 1):
            if d > 1:
                a.grow()
            if d < self.depth or self.last:
                alive.append(_hits(self.ranges, a.names[-1], {x["place"]: x["bits"] for x in row[f"b{d}"] or []}))
                a.keep(alive[-1])
        if not self.last:
            rows = list(_sent(self.ranges, a.names[-1], a.counts[-1], self.kind))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([row["shard"]] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["place", "shard", "names", "counts"])
        rows = list(a.states(alive))
        return pa.RecordBatch.from_arrays(
            [pa.array([row["lang"]] * len(rows), pa.string()), pa.array([r[0].decode() for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
            ["lang", "longest", "shortest", "n"],
        )


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f) of the phrases of up to ``depth`` words with f >= ``least``; (lang, n), the words of each language), both written.

    A null text is empty, a null language is ``und``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    name = f"shards_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    packed = texts.mapInArrow(_shards(buckets, shard), "shard long, lang string, n long, words binary, ids binary, first binary")
    packed.write.option("path", path).option("compression", "zstd").option("parquet.block.size", 16 << 20).bucketBy(buckets, "shard").sortBy("shard").saveAsTable(name)
    shards = spark.table(name)
    total = shards.agg(F.sum("n")).first()[0] or 0
    sizes = cut(shards.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"))
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-5 * total // RANGE))
    ranges, now = _Ranges(count, np.uint32), shards
    for d in range(1, depth + 1):
        sent = now.mapInArrow(_Depth(d, ranges, _kind(least), False), "place long, shard long, names binary, counts binary")
        back = sent.repartition(count, "place").sortWithinPartitions("place").mapInArrow(_frequent(least), "shard long, place long, bits binary")
        now = now.join(cut(back.groupBy("shard").agg(F.collect_list(F.struct("place", "bits")).alias(f"b{d}"))), "shard", "left")
    states = now.mapInArrow(_Depth(depth, ranges, _kind(least), True), "lang string, longest string, shortest int, n long")
    # along the suffix links: a state stands for its longest substring's suffixes, down to the shortest
    words = F.split("longest", " ")
    each = states.select("lang", words.alias("w"), "n", F.explode(F.sequence("shortest", F.size(words))).alias("size"))
    each = each.select("lang", "size", F.array_join(F.slice("w", -F.col("size"), F.col("size")), " ").alias("phrase"), "n")
    found = written(each.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    discard(spark, path, name)
    return found, sizes


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, cover: int = COVER, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then a, then phrase; ``docs`` needs text and lang.

    A-Z count as a-z. Texts are split at ``.,;:!?`` and line ends into pieces, pieces at spaces and tabs into words; a phrase lies within
    a piece; a shard has about ``shard`` bytes of text, which changes no result. a is the phrase's number of occurrences, overlapping ones included, at least ``least``; l and r are those of the parts of the
    cut with the least score floor(2,000,000 a / (l + r)), of several the first one; n is the language's number of words. A phrase is left
    out if a longer one of ``depth`` words at most has its words in a row and at least ``cover`` hundredths of its count. A null text is
    empty, a null language counts as ``und``; repeated rows count again; an empty table gives an empty one. Arithmetic is in decimals.
    """
    found, sizes = phrase_counts(docs, depth, least, shard)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    phrases = found.filter("size > 1").withColumnRenamed("f", "a")
    around = phrases.filter("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("around"))
    around = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    held = phrases.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (exact("around") * 100 < exact("a") * cover))
    cuts = held.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size")).alias("right"))
    count = lambda c, to: found.select("lang", F.col("phrase").alias(c), F.col("f").alias(to))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, by counting every run of words.
SQL = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
g as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
s as (select lang, ws, i, unnest(range(1, least({DEPTH}, len(ws) - i + 1) + 1)) as size from g),
f as materialized (select lang, size, array_to_string(ws[i : i + size - 1], ' ') as phrase, count(*) as f from s group by all),
sizes as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as materialized (select lang, size, phrase, f as a, string_split(phrase, ' ') as ws from f where size > 1 and f >= {LEAST}),
longer as (
  select lang, array_to_string(ws[i : i + n - 1], ' ') as phrase, max(a) as around
  from (select lang, ws, size, a, n, unnest(range(1, size - n + 2)) as i from (select *, unnest(range(2, size)) as n from c)) group by all),
h as (select c.* from c left join longer using (lang, phrase) where around is null or 100::hugeint * around < {COVER}::hugeint * a),
k as (select *, unnest(range(1, size)) as k from h),
v as (
  select k.lang, k.phrase, a, k.k, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f::hugeint + y.f))::bigint as score
  from k join f x on x.lang = k.lang and x.phrase = array_to_string(k.ws[1 : k.k], ' ') join f y on y.lang = k.lang and y.phrase = array_to_string(k.ws[k.k + 1 : k.size], ' ')),
b as (select lang, phrase, a, l, r, score from v qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from o join sizes using (lang) where rank <= {TOP}
"""
