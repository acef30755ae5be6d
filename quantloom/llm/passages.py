"""Near-duplicate passages by compact windows.

A passage is a run of WORDS words or more; its set is that of its five-word shingles. For each of HASHES hash functions the Cartesian
tree over a text's shingle hashes gives the compact windows (l, c, r): every run of shingles that lies within [l, r] and holds c has
its least hash at c, so one row stands for all of them. Only windows that can hold a passage are made, about two for each passage
length of text.

Shingles that stand once in the corpus are told first, by sorting their names in ranges. Similar passages have SHARE of theirs in common,
so they lie in stretches of text that passages with SHARE of repeating shingles cover, and windows are made of these stretches only. Two
passages of that similarity share a signature under one hash function with a probability of 0.75 or more, and so under one of HASHES
with 0.999; equal passages always do.

Windows with the same shingles around c, as far as SIDE, have the same matches: they are linked at once, and one stands for all. The
intervals of one signature are joined with the signature's least one, its leader's, and the matches of two documents are taken
together, so that a pair of documents is verified once however many windows it shares. Around each match the shingles are compared in
place, which finds the passages with words replaced, as long as they are; where that finds nothing, all lengths on both sides are tried,
which finds those with words put in or left out. A passage pair is confirmed on the sets.

Windows that remain in a passage of no match, or whose signature's documents lie in different components, are then held against all
others of their signature, by pairs of blocks, so that no near pair of a group is left in two components. Only windows that have enough
shingles in common are held against each other. No group is expanded into pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, cut, mix, seeds, shingle_hashes, word_hashes, written
from .components import star_components
from .minhash import _Union
from .substrings import _Level, _Ranges, _texts, answered, pack

WORDS, WIDTH, HASHES = 50, 5, 5
SHINGLES = WORDS - WIDTH + 1
SHARE = (75, 100)
#: Shingles to each side of a window's centre that are compared. Longer similar passages hold similar ones that are not: at a shingle
#: in common they part in two, of which one is similar, unless a part is under SHINGLES. If it is at every such shingle, there are
#: at most 2 * SHINGLES, and so no more than 2 * SHINGLES / 0.75 in either passage.
SIDE = 2 * SHINGLES * SHARE[1] // SHARE[0] - 1
#: Documents of one leader that one task verifies; windows of one signature that one task compares with each other or with as many others.
STAR, BLOCK = 256, 2048
_SEEDS = seeds(HASHES, 9000)


def compact_windows(values: np.ndarray, least: int = SHINGLES, runs: bool = False) -> list[tuple[int, int, int]]:
    """(l, c, r), inclusive, of the Cartesian tree over ``values`` whose interval has ``least`` elements or more. Of equal values the first is less.

    ``runs``: without those that start inside a run of equal values, as starting at the run's first gives the same sets, in longer passages.
    """
    after = np.arange(1, len(values) + 1)
    if runs and len(values):
        last = np.flatnonzero(np.append(values[1:] != values[:-1], True))
        after = (last + 1)[np.searchsorted(last, after - 1)]
    out, open_ = [], [(0, len(values))]
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        c = a + int(values[a:b].argmin())
        out.append((a, c, b - 1))
        open_ += [(a, c), (int(after[c]), b)]
    return out


def _runs(inside: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def repeating(again: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that passages of which SHARE of the shingles stand ``again`` cover; texts have ``sizes`` and lie one after the other.

    Distinct shingles that a similar passage lacks stand once, others may count several times: so all similar passages lie in there.
    """
    step = np.where(again, SHARE[1] - SHARE[0], -SHARE[0]).astype(np.int64)
    score = np.zeros(len(step) + 1, dtype=np.int64)
    np.cumsum(step, out=score[1:])
    # of any length first; what follows a text lies lower than all of it, so that nothing goes over its end
    lower = np.repeat(np.arange(len(sizes), dtype=np.int64) * (SHARE[1] * (len(step) + 1)), sizes)
    inside = np.maximum.accumulate((score[1:] - lower)[::-1])[::-1] >= np.minimum.accumulate(score[:-1] - lower)
    first = np.zeros(len(step) + 1, dtype=bool)
    first[np.append(0, np.cumsum(sizes, dtype=np.int64))] = True
    first[1:-1] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(first)
    long = (np.diff(cuts) >= SHINGLES) & inside[cuts[:-1]]
    for a, b in zip(cuts[:-1][long].tolist(), cuts[1:][long].tolist(), strict=True):
        own = score[a : b + 1]
        far = b - a - np.searchsorted(np.maximum.accumulate(own[::-1]), own, side="left")  # the last end for each start
        starts = np.flatnonzero(far - np.arange(b - a + 1) >= SHINGLES)
        edge = np.bincount(starts, minlength=b - a + 1) - np.bincount(far[starts], minlength=b - a + 1)
        yield from ((a + c, a + d) for c, d in _runs(np.cumsum(edge[:-1]) > 0))


def windows(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(c of each window; names) of a stretch of a text under all hash functions."""
    places, names = [], []
    for k in range(HASHES):
        values = mix(shingles ^ _SEEDS[k])
        got = np.array([c for _, c, _ in compact_windows(values, runs=True)], dtype=np.int64)
        places.append(got)
        names.append(values[got])
    return np.concatenate(places), np.concatenate(names)


#: A window, with the hash of the shingles around its c; or, without name, a passage that stands in the block again: in doc at c, in rep at at;
#: or, without rep either, how many words (size) a text has that stands in several rows.
_HIT = pa.schema([
    ("name", pa.int64()), ("around", pa.int64()), ("doc", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("c", pa.int32()), ("before", pa.int32()), ("size", pa.int32()),
    ("rep", pa.int64()), ("at", pa.int32()),
])
HIT = "name long, around long, doc long, block long, place int, c int, before int, size int, rep long, at int"


class _Windows:
    """Reads blocks: at level 1 sends the names of shingles, at level 2 the rows of windows where passages of shingles that repeat may lie."""

    def __init__(self, level: int, ranges: _Ranges) -> None:
        self.level, self.ranges = level, ranges

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                with np.errstate(over="ignore"):
                    yield self.block(batch.slice(k, 1).to_pylist()[0])

    def block(self, row: dict) -> pa.RecordBatch:
        firsts = set(row["first_at"] or ())
        out = set(row["copied_at"] or ()) - firsts
        pairs = list(_texts(row["held"], row["data"], out))
        made = [(place, shingle_hashes(w, WIDTH)) for (place, _), w in zip(pairs, word_hashes([t.tobytes() for _, t in pairs]), strict=True) if len(w) >= WORDS]
        every = np.concatenate([s for _, s in made]) if made else np.zeros(0, U)
        if self.level == 1:
            return _Level.message(row["block"], list(self.ranges.sent(every, every)))
        again = self.ranges.hits(every, every, {x["place"]: x["bits"] for x in row["bits"] or []})
        short = every.astype(np.uint32)
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        out = [(None, None, row["ids"][place], None, None, None, None, len(s) + WIDTH - 1, None, None) for place, s in made if place in firsts]
        sizes = [len(s) for _, s in made]
        ends = np.cumsum(sizes)
        for a, b in repeating(again, sizes):
            k = int(np.searchsorted(ends, a, side="right"))
            start, end, place = int(ends[k]) - sizes[k], int(ends[k]), made[k][0]
            doc = row["ids"][place]
            if doc is None:
                continue
            places, names = windows(every[a:b])
            mine = again[a:b][places]
            for c, name in zip((places[mine] + a).tolist(), names[mine].view(np.int64).tolist(), strict=True):
                x, y = max(start, c - SIDE), min(end, c + SIDE + 1)
                around = xxhash.xxh64_intdigest(short[x:y].tobytes(), seed=c - x) - (1 << 63)
                if (name, around) in seen:
                    rep, first = seen[name, around]
                    runs.setdefault((rep, doc, x - start - first), []).append((first, first + y - x))
                else:
                    seen[name, around] = (doc, x - start)
                    out.append((name, around, doc, row["block"], place, c - start, c - x, y - x, None, None))
        for (rep, doc, shift), parts in runs.items():
            parts.sort()
            first, last = parts[0]
            for x, y in [*parts[1:], (1 << 62, 0)]:
                if x > last:
                    out.append((None, None, doc, None, None, first + shift, 0, last - first, rep, first))
                    first, last = x, y
                last = max(last, y)
        return _batch(out, _HIT)


def same_words(a: np.ndarray, ca: int, b: np.ndarray, cb: int) -> tuple[int, int, int, int] | None:
    """As ``match``, where all words around the centres are the same as far as both reach."""
    left, right = min(ca, cb), min(len(a) - ca, len(b) - cb)
    if left + right < SHINGLES or not np.array_equal(a[ca - left : ca + right], b[cb - left : cb + right]):
        return None
    return ca - left, cb - left, left + right, left + right


def _distinct(x: np.ndarray) -> np.ndarray:
    """As np.unique, which takes several times as long on arrays as short as these."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _firsts(x: np.ndarray) -> np.ndarray:
    if len(_distinct(x)) == len(x):
        return np.ones(len(x), dtype=bool)
    out = np.zeros(len(x), dtype=bool)
    out[np.unique(x, return_index=True)[1]] = True
    return out


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[i, j]: how far the first i of x and the first j of y are above SHARE: (s + t) * common - s * (distinct of x + distinct of y)."""
    one, other = _firsts(x), _firsts(y)
    out = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    same = (x[:, None] == y) & one[:, None] & other
    np.cumsum(np.cumsum(same, axis=0, dtype=np.int32), axis=1, out=out[1:, 1:])
    out *= SHARE[0] + SHARE[1]
    out -= SHARE[0] * np.append(0, np.cumsum(one)).astype(np.int32)[:, None]
    out -= SHARE[0] * np.append(0, np.cumsum(other)).astype(np.int32)
    return out


def _most(x: np.ndarray, centre: int, others: np.ndarray, repeats: bool, gain: int, loss: int) -> int:
    """The most that a passage of x about the centre has, at ``gain`` for each of its shingles among ``others`` (sorted) and ``loss`` for each that
    is not; of equal ones on a side the first counts. ``repeats``: some of x are equal."""
    place = np.searchsorted(others, x)
    place[place == len(others)] = 0
    step = np.where(others[place] == x, gain, -loss)
    if repeats:
        step[:centre][~_firsts(x[:centre][::-1])[::-1]] = 0
        step[centre:][~_firsts(x[centre:])] = 0
    left, right = np.zeros(centre + 1, dtype=np.int64), np.zeros(len(x) - centre + 1, dtype=np.int64)
    np.cumsum(step[:centre][::-1], out=left[1:])
    np.cumsum(step[centre:], out=right[1:])
    most = np.maximum.accumulate(right[::-1])[::-1]
    need = np.maximum(SHINGLES - np.arange(centre + 1), 1)
    here = need < len(most)
    return int((left[here] + most[need[here]]).max()) if here.any() else -_FAR


def _dense(x: np.ndarray, centre: int, others: np.ndarray, repeats: bool) -> bool:
    """Whether a passage of x about the centre may have SHARE of its distinct shingles among ``others`` (sorted): no similar one has less."""
    return _most(x, centre, others, repeats, SHARE[1] - SHARE[0], SHARE[0]) >= 0


#: Of s and t distinct shingles as many are common as each has in the other, so at most half of both counts. Similar passages have
#: (SHARE[0] + SHARE[1]) * common >= SHARE[0] * (s + t), so those in the other, at GAIN, weigh up those that are not, at LOSS.
GAIN, LOSS, _FAR = SHARE[1] - SHARE[0], 2 * SHARE[0], 1 << 20


def match(a: np.ndarray, ca: int, b: np.ndarray, cb: int) -> tuple[int, int, int, int] | None:
    """(start in a, start in b, shingles of a, shingles of b) of similar passages that hold the centres, or None.

    The scores of what lies left of the centres and right of them add up, so all lengths on both sides are tried; of all, the highest.
    Exact if no shingle of a passage stands again on the other side of its centre; a match is confirmed on the sets in any case.
    """
    if (found := same_words(a, ca, b, cb)) is not None:
        return found
    one, other = _distinct(a), _distinct(b)
    if _most(a, ca, other, len(one) < len(a), GAIN, LOSS) + _most(b, cb, one, len(other) < len(b), GAIN, LOSS) < 0:
        return None
    left, right = _scores(a[:ca][::-1], b[:cb][::-1]), _scores(a[ca:], b[cb:])
    # what the right sides have to add, the centres at least
    p, q = (np.maximum(SHINGLES - np.arange(n), 1) for n in left.shape)
    least_i, least_j = (int(np.searchsorted(-x, -(n - 1))) for x, n in zip((p, q), right.shape, strict=True))
    if least_i >= len(p) or least_j >= len(q):
        return None
    best = np.maximum.accumulate(np.maximum.accumulate(right[::-1, ::-1], axis=0), axis=1)[::-1, ::-1]
    total = left[least_i:, least_j:] + best[np.ix_(p[least_i:], q[least_j:])]
    k = int(total.argmax())
    if total.flat[k] < 0:
        return None
    i, j = k // total.shape[1] + least_i, k % total.shape[1] + least_j
    rest = right[p[i] :, q[j] :]
    k = int(rest.argmax())
    n, m = k // rest.shape[1] + int(p[i]), k % rest.shape[1] + int(q[j])
    x, y = set(a[ca - i : ca + n].tolist()), set(b[cb - j : cb + m].tolist())
    both = len(x & y)
    return (ca - i, cb - j, i + n, j + m) if SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both) else None


def aligned(a: np.ndarray, b: np.ndarray, shift: int, first: int, last: int) -> list[tuple[int, int, int, int]]:
    """As ``match``, of passages with words in the same places, b's ``shift`` after a's, from ``first`` to ``last`` in a: enough of them to cover all."""
    lo, hi = max(first, 0, -shift), min(last, len(a), len(b) - shift)
    if hi - lo < SHINGLES:
        return []
    # with m of n in common in place, (m, 2n - m) have the share where the steps sum to 0 or more
    score = np.zeros(hi - lo + 1, dtype=np.int64)
    np.cumsum(np.where(a[lo:hi] == b[lo + shift : hi + shift], SHARE[1] - SHARE[0], -2 * SHARE[0]), out=score[1:])
    most = np.maximum.accumulate(score[::-1])
    far = hi - lo - np.searchsorted(most, score, side="left")  # the last end for each start
    starts = np.flatnonzero(far - np.arange(hi - lo + 1) >= SHINGLES)
    out, end, k = [], -1, 0
    if len(starts):
        reach = np.maximum.accumulate(far[starts])
        while True:
            j = int(np.searchsorted(starts, end, side="right")) - 1
            if j >= 0 and reach[j] > end:
                k = int(np.searchsorted(reach, reach[j]))
            elif j + 1 < len(starts):
                k = j + 1
            else:
                break
            x, end = int(starts[k]), int(far[starts[k]])
            out.append((lo + x, lo + x + shift, end - x, end - x))
    return [p for p in out if alike(a[p[0] : p[0] + p[2]], b[p[1] : p[1] + p[3]])]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    x, y = _distinct(x), _distinct(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both)


def verified(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Similar passages of two texts (start in a, start in b, shingles of a, of b) about matches at ``ca`` and ``cb``; which matches lie in one."""
    found: list[tuple[int, int, int, int]] = []
    inside = np.zeros(len(ca), dtype=bool)
    shift = cb.astype(np.int64) - ca
    order = np.lexsort((ca, shift))
    shifts, places = shift[order], ca[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (shifts[1:] != shifts[:-1]) | (places[1:] - places[:-1] > 2 * SIDE)
    cuts = np.append(np.flatnonzero(new), len(order))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        run = order[x:y]
        got = aligned(a, b, int(shift[run[0]]), int(ca[run[0]]) - SIDE, int(ca[run[-1]]) + SIDE + 1)
        for p in got:
            inside[run] |= (ca[run] >= p[0]) & (ca[run] < p[0] + p[2])
        found += got
    none: set[tuple[int, int]] = set()  # matches of several hash functions may lie in the same places
    for k in np.flatnonzero(~inside).tolist():
        i, j = int(ca[k]), int(cb[k])
        if (i, j) in none:
            continue
        if any(p[0] <= i < p[0] + p[2] and p[1] <= j < p[1] + p[3] for p in found):
            inside[k] = True
            continue
        la, lb = max(0, i - SIDE), max(0, j - SIDE)
        x, y = a[la : i + SIDE + 1], b[lb : j + SIDE + 1]
        if len(x) < SHINGLES or len(y) < SHINGLES:
            continue
        p = match(x, i - la, y, j - lb)
        if p is not None:
            found.append((p[0] + la, p[1] + lb, p[2], p[3]))
            inside[k] = True
        else:
            none.add((i, j))
    return found, inside


LINK = ("rep", "member", "at", "to", "size", "length")
_LINKS = pa.schema([(c, pa.int64()) for c in LINK])
_TOLD = pa.schema([("rep", pa.int64()), ("member", pa.int64()), ("passages", pa.list_(pa.list_(pa.int64()))), ("missed", pa.list_(pa.int64()))])
TOLD = "rep long, member long, passages array<array<long>>, missed array<long>"


class _Common:
    """How many distinct shingles rows have in common, and which of them may match."""

    def __init__(self, arrays: list[np.ndarray], centres: list[int]) -> None:
        self.rows = len(arrays)
        _, ids = np.unique(np.concatenate(arrays), return_inverse=True)
        sizes = np.array([len(x) for x in arrays])
        owner = np.repeat(np.arange(self.rows), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - np.repeat(centres, sizes)
        key = _distinct(ids.astype(np.int64) * self.rows + owner)
        none, self.repeat = int(ids.max()) + 1, len(key) < len(owner)
        self.sides = [self.side(owner[on], at[on], ids[on], none) for on, at in ((place < 0, -1 - place), (place >= 0, place))]
        self.where = np.full(none + 1, -1, dtype=np.int32)
        self.owner, of = key % self.rows, key // self.rows
        self.starts = np.searchsorted(of, np.arange(int(of[-1]) + 2))
        order = np.argsort(self.owner, kind="stable")
        self.of, self.ends = of[order], np.cumsum(np.bincount(self.owner, minlength=self.rows))

    def distinct(self, row: int) -> int:
        return int(self.ends[row] - (self.ends[row - 1] if row else 0))

    def counts(self, row: int) -> np.ndarray:
        ids = self.of[(self.ends[row - 1] if row else 0) : self.ends[row]]
        first, n = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(n)
        return np.bincount(self.owner[np.repeat(first - ends + n, n) + np.arange(ends[-1])], minlength=self.rows)

    def side(self, owner: np.ndarray, at: np.ndarray, ids: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What lies on one side of the centres, a row each, from the centre on: shingles, what each counts if it is not in the other row, and which are first."""
        held = np.full((self.rows, int(at.max(initial=-1)) + 1), none, dtype=np.int32)
        held[owner, at] = ids
        first = np.zeros(held.shape, dtype=bool)
        if self.repeat:
            first.ravel()[np.unique((np.arange(self.rows, dtype=np.int64)[:, None] * (none + 1) + held).ravel(), return_index=True)[1]] = True
        else:
            first[:] = True
        there = held < none
        first &= there
        return held, np.where(there, np.where(first, -LOSS, 0), -_FAR).astype(np.int32), first

    def may_match(self, row: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` for which ``match`` may find something: by GAIN and LOSS of both rows."""
        if not len(others):
            return others
        own, other = [], []
        for held, lost, first in self.sides:
            mine = np.flatnonzero(first[row])
            self.where[held[row, mine]] = mine
            to = self.where[held[others]]
            self.where[held[row, mine]] = -1
            hit = (to >= 0) & first[others]
            a, b = np.repeat(lost[row][None], len(others), axis=0), lost[others]
            b[hit] += GAIN + LOSS
            a[np.nonzero(hit)[0], to[hit]] += GAIN + LOSS
            for steps, out in ((a, own), (b, other)):
                score = np.zeros((len(others), steps.shape[1] + 1), dtype=np.int32)
                np.cumsum(steps, axis=1, out=score[:, 1:])
                out.append(score)
        need = np.maximum(SHINGLES - np.arange(own[0].shape[1]), 1)
        here = need < own[1].shape[1]
        if not here.any():
            return others[:0]
        best = [(left[:, here] + np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1][:, need[here]]).max(axis=1) for left, right in (own, other)]
        return others[best[0] + best[1] >= 0]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in the first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema.types, strict=True)], schema=schema)


def _asked(row: dict) -> dict[int, np.ndarray]:
    """The shingles of the texts of a block that are asked for, by place, in 32 bits."""
    places = {x["place"] for x in row["asked"]}
    out = {}
    with np.errstate(over="ignore"):
        for place, text in _texts(row["held"], row["data"], set()):
            if place in places:
                out[place] = shingle_hashes(next(word_hashes([text.tobytes()])), WIDTH).astype(np.uint32)
    return out


def _sent(schema: pa.Schema, rows_of):
    """Reads blocks with what is asked of them (block, held, data, asked); rows go on in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                out, size = [], 0
                for x, n in rows_of(row, _asked(row)):
                    out.append(x)
                    size += n
                    if size > 1 << 22:
                        yield _batch(out, schema)
                        out, size = [], 0
                yield _batch(out, schema)

    return run


_PAIRED = pa.schema([
    ("rep", pa.int64()), ("rep_block", pa.int64()), ("rep_place", pa.int32()), ("salt", pa.int32()), ("follows", pa.bool_()), ("doc", pa.int64()),
    ("names", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int32()), ("shingles", pa.binary()),
])
PAIRED = "rep long, rep_block long, rep_place int, salt int, follows boolean, doc long, names array<long>, a array<int>, b array<int>, start int, shingles binary"


def _paired(row: dict, texts: dict[int, np.ndarray]) -> Iterator[tuple[tuple, int]]:
    """The shingles from the first match to the last one, and SIDE more on either side, which is as far as a match is followed."""
    for x in row["asked"]:
        at = x["b"] if x["follows"] else x["a"]
        start = max(0, min(at) - SIDE)
        data = texts[x["place"]][start : max(at) + SIDE + 1].tobytes()
        yield (*(x[c] for c in _PAIRED.names[:-2]), start, data), len(data) + 16 * len(x["names"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (PAIRED), sorted so that the leader's document comes first: for each other one the passages that it has in common with it, and
    the names of the matches that lie in none."""
    star, centre, first = None, np.zeros(0, dtype=np.uint32), 0
    for batch in batches:
        for at in range(0, len(batch), 256):
            out = []
            for rep, *key, follows, doc, names, a, b, start, data in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                x = np.frombuffer(data, dtype=np.uint32)
                if not follows:
                    star, centre, first = key, x, start
                elif star == key:
                    found, inside = verified(centre, x, np.array(a, dtype=np.int32) - first, np.array(b, dtype=np.int32) - start)
                    out.append((rep, doc, [[int(p[0]) + first, int(p[1]) + start, int(p[2]), int(p[3])] for p in found], np.array(names, dtype=np.int64)[~inside].tolist()))
            yield _batch(out, _TOLD)


_AROUND = pa.schema([
    ("name", pa.int64()), ("minors", pa.int32()), ("majors", pa.int32()), ("around", pa.binary()), ("centre", pa.int32()), ("doc", pa.int64()), ("start", pa.int32()),
    ("met", pa.bool_()), ("minor", pa.bool_()), ("component", pa.int64()),
])
AROUND = "name long, minors int, majors int, around binary, centre int, doc long, start int, met boolean, minor boolean, component long"


def _around(row: dict, texts: dict[int, np.ndarray]) -> Iterator[tuple[tuple, int]]:
    for x in row["asked"]:
        a = max(0, x["c"] - SIDE)
        data = texts[x["place"]][a : x["c"] + SIDE + 1].tobytes()
        yield (x["name"], x["minors"], x["majors"], data, x["c"] - a, x["doc"], a, x["met"], x["minor"], x["component"]), len(data)


def _answered(blocks: DataFrame, asks: DataFrame, schema: pa.Schema, columns: str, rows_of) -> DataFrame:
    """``rows_of`` the texts at the places of ``asks`` (block, place and more); ``blocks`` stay where they are."""
    asked = asks.groupBy("block").agg(F.collect_list(F.struct(*(c for c in asks.columns if c != "block"))).alias("asked"))
    return blocks.join(written(asked), "block").select("block", "held", "data", "asked").mapInArrow(_sent(schema, rows_of), columns)


def _leaders(windows_: DataFrame) -> DataFrame:
    """(name, rep, rep_block, rep_place, rep_c) of the names with several windows."""
    least = windows_.groupBy("name").agg(F.min(F.struct("doc", "block", "place", "c")).alias("x"), F.count("*").alias("n")).filter("n > 1")
    return least.select("name", F.col("x.doc").alias("rep"), F.col("x.block").alias("rep_block"), F.col("x.place").alias("rep_place"), F.col("x.c").alias("rep_c"))


_REP = ("rep", "rep_block", "rep_place")


def _pairs(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*_REP, "doc", "block", "place").agg(F.collect_list(F.struct("name", F.col("rep_c").alias("a"), F.col("c").alias("b"))).alias("matches"))


def _verified(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """What ``_told`` says of ``pairs``. A leader of any number of documents is dealt to tasks in parts of about STAR, each with its text."""
    sizes = cut(pairs.groupBy(*_REP).agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"), F.min(F.array_min("matches.a")).alias("x"), F.max(F.array_max("matches.a")).alias("y")))
    salt = F.pmod(F.xxhash64("block", "place"), F.col("parts")).cast("int").alias("salt")
    field = lambda c: F.transform("matches", lambda x: x[c])
    members = pairs.join(sizes, list(_REP)).select(*_REP, salt, F.lit(True).alias("follows"), "doc", "block", "place", field("name").alias("names"), field("a").alias("a"), field("b").alias("b"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    centres = sizes.select(
        *_REP, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("follows"), F.col("rep").alias("doc"),
        F.col("rep_block").alias("block"), F.col("rep_place").alias("place"), none("bigint").alias("names"), F.array("x", "y").alias("a"), none("int").alias("b"),
    )
    rows = _answered(blocks, members.union(centres), _PAIRED, PAIRED, _paired)
    return cut(rows.repartition(*_REP, "salt").sortWithinPartitions(*_REP, "salt", "follows").mapInArrow(_told, TOLD))


def _links(told: DataFrame) -> DataFrame:
    return told.select("rep", "member", F.explode("passages").alias("p")).select("rep", "member", *(F.col("p")[k].alias(c) for k, c in enumerate(LINK[2:])))


def _stars(links: DataFrame) -> DataFrame:
    return links.select("rep", "member").filter("rep <> member")


def _spans(links: DataFrame) -> DataFrame:
    """(doc_id, m): the union of the passages of each document, from and to a word, as an array of (a, b)."""
    places = links.select(F.col("rep").alias("doc_id"), F.col("at").alias("a"), "size").union(links.select(F.col("member").alias("doc_id"), F.col("to").alias("a"), "length"))
    places = places.distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", (F.col("a") + F.col("size") + WIDTH - 1).alias("b")))).alias("p"))
    merged = F.expr(
        "aggregate(p, cast(array() as array<struct<a: bigint, b: bigint>>), (m, x) -> if(size(m) > 0 and x.a <= element_at(m, -1).b,"
        " concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, x.b)))), concat(m, array(x))))"
    )
    return places.select("doc_id", merged.alias("m"))


def _standing(windows_: DataFrame, links: DataFrame, whole: DataFrame) -> DataFrame:
    """``windows_`` with the component of their document, and met: whether they lie in a passage of ``links``."""
    comp = star_components(cut(_stars(links).union(whole).distinct())).withColumnRenamed("node", "doc")
    facts = cut(comp.join(_spans(links).withColumnRenamed("doc_id", "doc"), "doc", "full_outer"))
    now = windows_.join(facts, "doc", "left")
    met = F.coalesce(F.expr(f"exists(m, x -> x.a <= c and c + {WIDTH} <= x.b)"), F.lit(False))
    return now.select(*windows_.columns, F.coalesce("component", "doc").alias("component"), met.alias("met"))


def _equal_links(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of windows whose surroundings are the same, and the windows (name, doc, block, place, c) with one of each such group."""
    windows_ = hits.filter("name is not null")
    least = windows_.groupBy("name", "around").agg(F.min(F.struct("doc", "block", "place", "c")).alias("x"), F.count("*").alias("n"))
    least = written(least)
    again = least.filter("n > 1").select("name", "around", F.col("x.doc").alias("r"), F.col("x.block").alias("r_block"), F.col("x.place").alias("r_place"), F.col("x.c").alias("r_c"))
    again = windows_.join(again, ["name", "around"]).filter("block <> r_block or place <> r_place or c <> r_c")
    again = again.select(F.col("r").alias("rep"), F.col("doc").alias("member"), (F.col("r_c") - F.col("before")).alias("at"), (F.col("c") - F.col("before")).alias("to"), "size", F.col("size").alias("length"))
    inside = hits.filter("name is null and rep is not null").select("rep", F.col("doc").alias("member"), "at", F.col("c").alias("to"), "size", F.col("size").alias("length"))
    links = again.union(inside).select(*(F.col(c).cast("long").alias(c) for c in LINK)).distinct()
    return written(links), least.select("name", "x.doc", "x.block", "x.place", "x.c")


def _leader_links(windows_: DataFrame, links: DataFrame, whole: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of ``windows_`` (name, doc, block, place, c) with the leaders of their names, and the names of which a window is not linked so.

    What lies in a passage of ``links``, and in one component, is not looked at again. A document is first verified with the leader that
    it has the most matches with; then with others, for what is left.
    """
    first = written(_leaders(windows_))
    is_lead = (F.col("block") == F.col("rep_block")) & (F.col("place") == F.col("rep_place")) & (F.col("c") == F.col("rep_c"))

    def left(links: DataFrame) -> DataFrame:
        now = written(_standing(windows_, links, whole).join(first, "name"))
        lead = now.filter(is_lead).select("name", F.col("component").alias("lead_component"), F.col("met").alias("lead_met"))
        return now.filter(~is_lead).join(lead, "name").filter("not met or not lead_met or component <> lead_component")

    turn = F.expr(f"row_number() over (partition by block, place order by size(matches) desc, {', '.join(_REP)})")
    best = written(_pairs(left(links)).withColumn("turn", turn).filter("turn = 1").drop("turn"))
    told = _verified(best, blocks)
    more = _pairs(left(links.union(_links(told)))).join(best.select(*_REP, "block", "place"), [*_REP, "block", "place"], "left_anti")
    every = told.union(_verified(written(more), blocks))
    return _links(every), every.select(F.explode("missed").alias("name")).distinct()


def _crossing_links(windows_: DataFrame, links: DataFrame, missed: DataFrame, whole: DataFrame, blocks: DataFrame) -> DataFrame:
    """The links that leaders do not show: of windows that lie in no passage of ``links``, or not in the component of their leader."""
    left = written(_standing(windows_.join(missed, "name", "left_semi"), links, whole))
    lead = cut(left.groupBy("name").agg(F.min(F.struct("doc", "block", "place", "c", "component")).alias("x")).select("name", F.col("x.component").alias("lead")))
    left = written(left.join(lead, "name").withColumn("minor", F.expr("not met or component <> lead")).drop("lead"))
    parts = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / BLOCK).cast("int")
    names = cut(left.groupBy("name").agg(parts(F.col("minor")).alias("minors"), parts(~F.col("minor")).alias("majors")).filter("minors > 0"))
    return _crossing(_answered(blocks, left.join(names, "name"), _AROUND, AROUND, _around))


def _crossing(rows: DataFrame) -> DataFrame:
    """The links between ``rows`` (AROUND) of one name of which one is a minor one: all minors in pairs of blocks, and each block of minors
    with each of the others."""
    many = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.col(n)), lambda o: o < F.col(n)), f)
    pair = lambda i, j, both: F.struct(i.alias("i"), j.alias("j"), F.lit(both).alias("both"))
    own = F.col("block")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("around", "doc"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    to = F.when(F.col("minor"), F.concat(many("minors", lambda o: pair(F.least(own, o), F.greatest(own, o), True)), many("majors", lambda o: pair(own, o, False))))
    rows = rows.withColumn("to", F.explode(to.otherwise(many("minors", lambda o: pair(o, own, False)))))
    rows = rows.select("name", "to.i", "to.j", "to.both", "block", "around", "centre", "doc", "start", "met", "minor", "component")
    rows = rows.repartition("name", "i", "j", "both").sortWithinPartitions("name", "i", "j", "both", "block", "around")
    return cut(rows.mapInArrow(_crossed, ", ".join(f"{c} long" for c in LINK)))


def _may_match(rows: list[tuple], arrays: list[np.ndarray]) -> tuple[list[tuple], list[np.ndarray]]:
    """Those of ``rows`` that may have a passage about their centre in common with another: SHARE of it stands in others, until no more go."""
    repeats = [len(_distinct(x)) < len(x) for x in arrays]
    while len(rows) > 1:
        every = np.sort(np.concatenate([_distinct(x) if r else x for x, r in zip(arrays, repeats, strict=True)]))
        others = _distinct(every[1:][every[1:] == every[:-1]])
        keep = [len(others) > 0 and _dense(x, r[6], others, own) for r, x, own in zip(rows, arrays, repeats, strict=True)]
        if all(keep):
            break
        rows, arrays, repeats = ([v for v, k in zip(of, keep, strict=True) if k] for of in (rows, arrays, repeats))
    return rows, arrays


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, i, j, both, block, around, centre, doc, start, met, minor, component), sorted by the first six: the links between the
    blocks i and j of minors, or the block i of minors and j of others, of windows in different components or in no passage so far."""
    out: list[tuple] = []
    for rows in _groups(batches, 4):
        _, i, j, both, *_ = rows[0]
        arrays = [np.frombuffer(r[5], dtype=np.uint32) for r in rows]
        if len(rows) > 16:
            rows, arrays = _may_match(rows, arrays)
        if len(rows) < 2:
            continue
        centre, doc, start, comp = ([r[k] for r in rows] for k in (6, 7, 8, 11))
        block, minor = np.array([r[4] for r in rows]), np.array([r[10] for r in rows])
        met, union = [r[9] for r in rows], _Union()
        common = _Common(arrays, centre) if len(rows) > 3 else None
        # what a row has in common with a similar one, at least; one whose shingles repeat may have less
        few = -(-SHARE[0] * SHINGLES // SHARE[1])
        least = None if common is None else np.array([few if common.distinct(k) == len(x) else 1 for k, x in enumerate(arrays)])
        for k in np.flatnonzero(minor).tolist():
            near = (~minor) if not both else np.ones(len(rows), dtype=bool) if i == j else block != block[k]
            if both:
                near[: k + 1] = False
            if common is None:
                near = np.flatnonzero(near)
            else:
                counts = common.counts(k)
                near = np.flatnonzero(near & (counts >= np.minimum(least, least[k])))
                if met[k] and len(near):
                    near = near[[not (met[y] and union.root(comp[k]) == union.root(comp[y])) for y in near.tolist()]]
                near = near[np.argsort(-counts[near], kind="stable")]
                near = np.concatenate([common.may_match(k, near[x : x + 512]) for x in range(0, max(len(near), 1), 512)])
            for y in near.tolist():
                if met[k] and met[y] and union.root(comp[k]) == union.root(comp[y]):
                    continue
                if (found := match(arrays[y], centre[y], arrays[k], centre[k])) is not None:
                    union.join(comp[k], comp[y])
                    met[k] = met[y] = True
                    out.append((doc[y], doc[k], start[y] + found[0], start[k] + found[1], found[2], found[3]))
        if len(out) >= 2048:
            yield _batch(out, _LINKS)
            out = []
    yield _batch(out, _LINKS)


def near_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id, n_links, n_dup_words, spans) for every row of ``docs`` (doc_id, text; no other column is read).

    component_id is the least doc_id that links lead to, n_links the number of other documents that a document is linked with as
    leader or member, or across components (a count of confirmed links, not of all near pairs), spans (start:end in words) the passages
    of these links, which stand again elsewhere, or in itself, and n_dup_words their words. A
    document without such passages is its own component with no links. Documents that are wholly equal, and have WORDS words or more,
    are linked, and their span is all of their words. A null or short text has no passage; a row without doc_id takes
    no part and has a null component; an empty table gives an empty one.
    """
    state, copies, count, remove = pack(docs, 2 * WORDS - 1)
    ranges = _Ranges(count, np.uint32)
    now = state.select("block", "ids", "held", "data", "copied_at", "first_at")
    bits = answered(now.mapInArrow(_Windows(1, ranges), "place long, block long, names binary, twice binary"), count, np.uint32)
    rows = written(now.join(bits, "block", "left").mapInArrow(_Windows(2, ranges), HIT))
    blocks = state.select("block", "held", "data")
    # equal texts: copies of a text that has passages are linked with the one that took part
    long = rows.filter("name is null and rep is null and doc is not null").groupBy(F.col("doc").alias("first_id")).agg(F.max("size").alias("n"))
    twins = copies.filter("doc_id is not null and first_id is not null").select("doc_id", "first_id").distinct()
    whole = cut(twins.join(long, "first_id").select("doc_id", "first_id", "n"))
    twin_stars = whole.filter("doc_id <> first_id").select(F.col("first_id").alias("rep"), F.col("doc_id").alias("member"))
    equal, rows = _equal_links(rows)
    led, missed = _leader_links(rows, equal, twin_stars, blocks)
    links = equal.union(led)
    links = cut(links.union(_crossing_links(rows, links, missed, twin_stars, blocks)))
    remove()
    spans = _spans(links)
    stars = _stars(links).union(twin_stars)
    stars = cut(stars.distinct())
    comp = cut(star_components(stars))
    # a star's name is its rep, which need not be the least
    comp = comp.join(comp.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))
    ends = stars.select(F.col("rep").alias("doc_id")).union(stars.select(F.col("member").alias("doc_id")))
    n_links = ends.groupBy("doc_id").agg(F.count("*").alias("n_links"))
    told = spans.select("doc_id", F.expr("aggregate(m, 0L, (s, x) -> s + x.b - x.a)").alias("n_dup_words"), F.expr("array_join(transform(m, x -> concat(x.a, ':', x.b)), ',')").alias("spans"))
    told = told.join(whole.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id", "full_outer")
    told = told.select("doc_id", F.coalesce(F.col("n").cast("long"), "n_dup_words").alias("n_dup_words"), F.coalesce(F.concat(F.lit("0:"), F.col("n")), "spans").alias("spans"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(n_links, "doc_id", "left").join(told, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_dup_words", F.lit(0)).cast("long").alias("n_dup_words"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
