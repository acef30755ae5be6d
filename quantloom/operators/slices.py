"""Scans over slices: recurrences and running values of groups of any size, over many tasks.

Rows are dealt to ranges of (group, order), sorted there and written once: a partition is a slice, and a group may go over many of
them. A scan summarises each slice for its first and its last group, which are the only ones that others meet; what enters a slice is
carried from summary to summary, one row a slice; then each slice runs by itself from there. Rules work on whole arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Rows of a slice, about, at most.
ROWS = 1 << 20
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
Arrays = list[np.ndarray]


class Rule:
    """How a scan goes: ``state`` at a group's start, a chunk's ``summary``, summaries ``merged``, a state ``after`` a summary, and ``run``.

    Inputs are float arrays, nan for null, or integer ones where integers have no nulls; outputs are floats, nan for null, or arrays of their type without nulls.
    """

    def state(self) -> Any:
        raise NotImplementedError

    def summary(self, x: Arrays) -> Any:
        raise NotImplementedError

    def merged(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def after(self, state: Any, summary: Any) -> Any:
        raise NotImplementedError

    def run(self, state: Any, x: Arrays) -> tuple[Arrays, Any]:
        raise NotImplementedError


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For maps y -> a y + b along the last axis, each one after all before it; by doubling, without a division."""
    a, b, step = a.copy(), b.copy(), 1
    while step < a.shape[-1]:
        b[..., step:] = b[..., step:] + a[..., step:] * b[..., :-step]
        a[..., step:] = a[..., step:] * a[..., :-step]
        step *= 2
    return a, b


class Affine(Rule):
    """Recurrences y' = a y + b. ``maps`` gives a and b, one row a recurrence; ``finish`` makes the outputs of y and of what was before it."""

    def __init__(self, count: int, maps: Callable[[Arrays], tuple[np.ndarray, np.ndarray]], finish: Callable[[Arrays, np.ndarray, np.ndarray], Arrays]) -> None:
        self.count, self.maps, self.finish = count, maps, finish

    def state(self) -> np.ndarray:
        return np.zeros(self.count)

    def summary(self, x: Arrays) -> tuple[np.ndarray, np.ndarray]:
        a, b = composed(*self.maps(x))
        return a[:, -1], b[:, -1]

    def merged(self, a, b):
        return a[0] * b[0], b[0] * a[1] + b[1]

    def after(self, state, summary):
        return summary[0] * state + summary[1]

    def run(self, state, x):
        a, b = composed(*self.maps(x))
        y = a * state[:, None] + b
        before = np.concatenate([state[:, None], y[:, :-1]], axis=1)
        with np.errstate(all="ignore"):
            return self.finish(x, y, before), y[:, -1]


class Seen(Rule):
    """(rank, each input's last value before): rows without a nan are counted and remembered, others are passed over and get rank 0."""

    def __init__(self, inputs: int) -> None:
        self.inputs = inputs

    def state(self):
        return 0, np.full(self.inputs, np.nan)

    def summary(self, x):
        there = np.flatnonzero(~np.isnan(x).any(axis=0))
        return len(there), np.array([c[there[-1]] for c in x]) if len(there) else np.full(self.inputs, np.nan)

    def merged(self, a, b):
        return a[0] + b[0], b[1] if b[0] else a[1]

    after = merged

    def run(self, state, x):
        there = ~np.isnan(x).any(axis=0)
        count = np.cumsum(there)
        places = np.flatnonzero(there)
        out: Arrays = [np.where(there, state[0] + count, 0).astype(np.float64)]
        for k, c in enumerate(x):
            held = np.concatenate([[state[1][k]], c[places]])
            out.append(held[count - there])
        return out, self.merged(state, self.summary(x))


class Sums(Rule):
    """Running sums of the inputs, nan as 0, the row in; as numbers of ``kind``."""

    def __init__(self, inputs: int, kind: type = np.float64) -> None:
        self.inputs, self.kind = inputs, kind

    def state(self):
        return np.zeros(self.inputs, dtype=self.kind)

    def summary(self, x):
        return np.array([np.nan_to_num(c).astype(self.kind).sum() for c in x])

    def merged(self, a, b):
        return a + b

    after = merged

    def run(self, state, x):
        out = [s + np.cumsum(np.nan_to_num(c).astype(self.kind)) for s, c in zip(state, x, strict=True)]
        return out, np.array([c[-1] for c in out])


class Tops(Rule):
    """The running maximum of the input, the row in; of floats nan before there is one. Integers stay integers."""

    def state(self):
        return None

    def summary(self, x):
        return np.fmax.reduce(x[0])

    def merged(self, a, b):
        return b if a is None else np.fmax(a, b)

    after = merged

    def run(self, state, x):
        out = np.fmax.accumulate(x[0])
        out = out if state is None else np.fmax(out, state)
        return [out], out[-1]


class Tail(Rule):
    """What ``made`` gives for the inputs with up to ``n`` rows before them in front, padded with nan."""

    def __init__(self, inputs: int, n: int, made: Callable[[Arrays], Arrays]) -> None:
        self.inputs, self.n, self.made = inputs, n, made

    def state(self):
        return np.full((self.inputs, self.n), np.nan)

    def summary(self, x):
        return np.array(x)[:, -self.n :]

    def merged(self, a, b):
        return np.concatenate([a, b], axis=1)[:, -self.n :]

    after = merged

    def run(self, state, x):
        whole = np.concatenate([state, np.array(x)], axis=1)
        return self.made(list(whole)), whole[:, -self.n :]


@dataclass
class Stage:
    """One rule over columns: ``inputs``, and ``outputs`` as "name type, ..."."""

    inputs: list[str]
    outputs: str
    rule: Rule


def _columns(batch: pa.RecordBatch, names: list[str]) -> Arrays:
    out = []
    for n in names:
        c = batch.column(n)
        if pa.types.is_int64(c.type) and not c.null_count:
            out.append(c.to_numpy())
            continue
        c = c.cast(pa.float64()) if not pa.types.is_boolean(c.type) else c.cast(pa.int8()).cast(pa.float64())
        out.append(c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
    return out


def _groups(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(group, its rows) of a batch, in order."""
    if not len(batch):
        return
    change = np.zeros(len(batch) - 1, dtype=bool)
    for c in by:
        ids = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change |= ids[1:] != ids[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        part = batch.slice(x, y - x)
        yield tuple(part.column(c)[0].as_py() for c in by), part


@dataclass
class Slices:
    """Rows in slices: partition after partition they are in the order of (by, order). All scans of a slice run in one Python worker of its task."""

    base: DataFrame
    by: list[str]
    #: What each scan does to the batches of a slice, and the columns that it gives, as "name type".
    runs: list[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]] = field(default_factory=list)
    made: list[list[str]] = field(default_factory=list)
    #: The columns that scans read.
    read: list[str] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.rows()

    def rows(self, *without: str) -> DataFrame:
        """The rows with what all scans give, but for columns ``without``."""
        if not self.runs:
            return self.base.drop(*without)
        fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in self.base.schema.fields}
        for extra in self.made:
            for x in extra:  # a column that is made anew stands last
                n, t = x.split()
                fields.pop(n, None)
                fields[n] = f"`{n}` {t}"
        runs, names = self.runs, [n for n in fields if n not in without]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _through(runs, batches):
                yield batch.select(names)

        return self.base.mapInArrow(run, ", ".join(fields[n] for n in names))

    def scan(self, stages: list[Stage]) -> Slices:
        """With the outputs of ``stages``, which read what is there and not each other."""
        by, runs = self.by, self.runs
        read = list(dict.fromkeys([*self.read, *(c for s in stages for c in s.inputs)]))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(slice, summary): the first group and its summary, the last one and its, and whether they are one."""
            first: list = []
            now: list = []
            for batch in _through(runs, batches):
                for key, part in _groups(batch, by):
                    parts = [s.rule.summary(_columns(part, s.inputs)) for s in stages]
                    if now and now[0] == key:
                        now[1] = [s.rule.merged(a, b) for s, a, b in zip(stages, now[1], parts, strict=True)]
                    else:
                        first = first or now
                        now = [key, parts]
            if now:
                told = pickle.dumps((first or now, now, not first))
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([told], pa.binary())], ["slice", "told"])

        needed = [c for c in self.base.columns if c in by or c in read]
        # without a group and with inputs that scans make, any column tells how many rows there are
        rows = sorted(self.base.select(*(f"`{c}`" for c in needed or self.base.columns[:1])).mapInArrow(summed, "slice int, told binary").collect())
        enters: dict[int, tuple] = {}
        key, state = None, None
        for k, told in rows:
            first, last, one = pickle.loads(told)
            if key == first[0]:
                enters[k] = (key, state)
            else:
                state = [s.rule.state() for s in stages]
            if not one:
                state = [s.rule.state() for s in stages]
            key, state = last[0], [s.rule.after(a, b) for s, a, b in zip(stages, state, last[1], strict=True)]
        entered = self.base.sparkSession.sparkContext.broadcast(enters)
        extra = [x.split() for s in stages for x in s.outputs.split(", ")]
        made = [n for n, _ in extra]
        kinds = [_TYPES[t] for _, t in extra]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, states = entered.value.get(TaskContext.get().partitionId(), (None, None))
            states = states and list(states)  # the worker keeps the broadcast value for other tasks
            for batch in batches:
                for key, part in _groups(batch, by):
                    if key != now or states is None:
                        now, states = key, [s.rule.state() for s in stages]
                    out: Arrays = []
                    for k, s in enumerate(stages):
                        arrays, states[k] = s.rule.run(states[k], _columns(part, s.inputs))
                        out += arrays
                    new = [pa.array(c.astype(t.to_pandas_dtype()) if c.dtype.kind != "f" or not pa.types.is_floating(t) else c, t, from_pandas=True) for c, t in zip(out, kinds, strict=True)]
                    kept = [n for n in part.schema.names if n not in made]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *new], [*kept, *made])

        return Slices(self.base, by, [*runs, run], [*self.made, [" ".join(x) for x in extra]], read)

    def scans(self, specs: list[list[Stage]]) -> Slices:
        """Several chains of stages side by side: the first stages of all in one scan, then the second ones, and so on."""
        now = self
        for k in range(max(map(len, specs), default=0)):
            now = now.scan([s[k] for s in specs if k < len(s)])
        return now


def _through(runs: list[Callable], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a slice after ``runs``, one after the other."""
    for run in runs:
        batches = run(batches)
    return batches


def _told(batches: Iterator[pa.RecordBatch], by: list[str], of: Callable[[tuple, pa.RecordBatch], Any]) -> list[tuple[tuple, pa.RecordBatch, Any]]:
    """(group, its rows, what ``of`` makes of them) for all groups of a slice, whose rows are held together."""
    groups: list[tuple[tuple, list[pa.RecordBatch]]] = []
    for batch in batches:
        for key, part in _groups(batch, by):
            if groups and groups[-1][0] == key:
                groups[-1][1].append(part)
            else:
                groups.append((key, [part]))
    out = []
    for key, parts in groups:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        out.append((key, whole, of(key, whole)))
    return out


class Closes:
    """Where a running measure closes bars in a slice, whatever total it enters with.

    ``then``: for each row the row after the close of a bar that starts there, or one past the end and ``open``. Prefix sums say where: a bar
    from s closes at the first row j from s on with P(j) - P(s - 1) >= threshold(j), where the gate is open. Following the pointers by
    doubling gives for each row the start of the bar that is open at the slice's end, and how many bars have closed till then. With
    that, all entering totals come to a table: those that first close at one row leave alike.
    """

    def __init__(self, m: np.ndarray, t: np.ndarray, gate: np.ndarray) -> None:
        n = len(m)
        self.n, self.sums = n, np.concatenate([[0.0], np.cumsum(m)])
        after = self.sums[1:]
        open_ = gate & ~np.isnan(t)
        reach = np.where(open_, after - np.nan_to_num(t), -np.inf)
        if (m >= 0).all() and not (open_ & (t <= 0)).any():
            first = np.searchsorted(np.maximum.accumulate(reach), self.sums[:-1], side="left")
        else:
            first = np.full(n, n)
            for s in range(n):  # measures or thresholds that are not positive: no order to search by
                rest = np.flatnonzero(reach[s:] >= self.sums[s])
                first[s] = s + rest[0] if len(rest) else n
        #: the row after the close; where none comes, the bar stays open at its own start
        self.closes = np.append(first < n, False)
        self.then = np.append(np.where(first < n, first + 1, np.arange(n)), n)
        self.needs = np.where(open_, np.nan_to_num(t) - after, np.inf)

    def leaving(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(least entering totals, descending, the totals with which the slice is left, bars closed) and the slice's sum for lesser totals."""
        to, count = self.then.copy(), self.closes.astype(np.int64)
        while True:
            nxt = to[to]
            if (nxt == to).all():
                break
            count = count + count[to]
            to = nxt
        low = np.minimum.accumulate(self.needs)
        record = np.flatnonzero((self.needs < np.concatenate([[np.inf], low[:-1]])) & np.isfinite(self.needs))
        # a bar that enters with 0 or more closes by the first row that needs nothing more
        done = np.flatnonzero(self.needs[record] <= 0)
        record = record[: done[0] + 1] if len(done) else record
        total = self.sums[self.n] - self.sums[to[record + 1]]
        bars = count[record + 1] + 1
        keep = np.ones(len(record), dtype=bool)
        if len(record) > 1:  # neighbours that leave alike are one row, with the lesser need
            keep[:-1] = (total[1:] != total[:-1]) | (bars[1:] != bars[:-1])
        return self.needs[record][keep], total[keep], bars[keep], float(self.sums[self.n])

    def bars(self, total: float, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(bar numbers, closes) of the rows, entered with an open bar ``bar`` of ``total``."""
        marks = np.zeros(self.n, dtype=bool)
        hit = np.flatnonzero(self.needs <= total)
        if len(hit):
            at = int(hit[0])
            marks[at] = True
            at, then, closes = at + 1, self.then, self.closes
            while closes[at]:
                at = int(then[at])
                marks[at - 1] = True
        return bar + np.concatenate([[0], np.cumsum(marks)[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64), marks


def left(table: tuple[np.ndarray, np.ndarray, np.ndarray, float], total: float, bar: int) -> tuple[float, int]:
    """The open bar's total and number behind a slice that is entered with ``total`` in bar ``bar``."""
    needs, totals, bars, whole = table
    k = int(np.searchsorted(-needs, -total, side="left"))
    return (float(totals[k]), bar + int(bars[k])) if k < len(needs) else (total + whole, bar)


def numbered_bars(s: Slices, measure: str, threshold: str, gate: str) -> DataFrame:
    """The rows of ``s`` with i (place in the group), bar_no and closes: a bar closes at the row at which the running ``measure`` reaches
    ``threshold`` while ``gate`` holds, and the rest of the measure is dropped.

    Each slice tells how it is left for any total that it may be entered with. One pass over these tables, which hold what happens to a
    slice's first bar, says what enters; it is a stream of a table a slice. Then each slice numbers its bars.
    """
    by, spark = s.by, s.df.sparkSession

    def closes(_: tuple, part: pa.RecordBatch) -> Closes:
        m, t, g = _columns(part, [measure, threshold, gate])
        return Closes(np.nan_to_num(m), t, np.nan_to_num(g) > 0)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _told(batches, by, closes)
        if groups:
            (key, rows, first), (last_key, last_rows, last) = groups[0], groups[-1]
            told = pickle.dumps((key, len(rows), first.leaving(), last_key, len(last_rows), last.leaving() if len(groups) > 1 else None))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([told], pa.binary())], ["slice", "told"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each slice is entered with: (slice, entry)."""
        now, place, total, bar = None, 0, 0.0, 0
        for batch in batches:
            out = []
            for k, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, n, first, last_key, last_n, last = pickle.loads(told)
                if key != now:
                    place, total, bar = 0, 0.0, 0
                out.append(pickle.dumps((key, place, total, bar)))
                if last is None:
                    place, (total, bar) = place + n, left(first, total, bar)
                else:
                    place, (total, bar) = last_n, left(last, 0.0, 0)
                now = last_key
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["slice", "entry"])

    cols = [*by, measure, threshold, gate]
    sent = s.df.select(*(f"`{c}`" for c in cols)).mapInArrow(tables, "slice int, told binary")
    entries = sent.repartition(1).sortWithinPartitions("slice").mapInArrow(walked, "slice int, entry binary").collect()
    entered = spark.sparkContext.broadcast({r["slice"]: pickle.loads(r["entry"]) for r in entries})
    kept = [f for f in s.df.schema.fields if f.name not in ("i", "bar_no", "closes")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", i long, bar_no long, closes boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = entered.value.get(TaskContext.get().partitionId())
        for key, rows, c in _told(batches, by, closes):
            _, place, total, bar = entry if entry and entry[0] == key else (key, 0, 0.0, 0)
            entry = None
            no, marks = c.bars(total, bar)
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), pa.array(place + np.arange(len(rows))), pa.array(no), pa.array(marks)], [*(f.name for f in kept), "i", "bar_no", "closes"])

    return s.df.mapInArrow(run, schema)


def sliced(df: DataFrame, by: list[str], order: list[str]) -> Slices:
    """``df`` in slices, written once."""
    ship(df.sparkSession)
    count = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    at = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    return Slices(cut(df.repartitionByRange(count, *at).sortWithinPartitions(*at)), by)
