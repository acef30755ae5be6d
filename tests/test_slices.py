"""Scans over slices against row after row."""

import random

import numpy as np
import pytest

from quantloom.functions import indicators
from quantloom.operators import bars, slices
from quantloom.operators.slices import Closes, Seen, Sums, Tops, left
from quantloom.plans import features as FS


def plain(m, t, g, total=0.0, bar=0):
    """Bar numbers and closes, tick after tick; the total and number that are left."""
    no, marks = [], []
    for x, y, z in zip(m, t, g, strict=True):
        total += x
        no.append(bar)
        closes = bool(z) and not np.isnan(y) and total >= y
        marks.append(closes)
        if closes:
            total, bar = 0.0, bar + 1
    return no, marks, total, bar


@pytest.mark.parametrize("case", range(12))
def test_any_entering_total_leaves_as_tick_after_tick(case):
    rng = np.random.default_rng(case)
    n = int(rng.integers(1, 60))
    m = rng.integers(0 if case % 3 else -2, 9, n).astype(float)
    t = np.full(n, 12.0) if case % 2 else rng.integers(-1 if case % 5 == 0 else 1, 25, n).astype(float)
    t[rng.random(n) < 0.1] = np.nan
    g = rng.random(n) < 0.8
    c = Closes(m, t, g)
    table = c.leaving()
    for total in range(0, 40):
        no, marks, after, bar = plain(m, t, g, float(total), 3)
        got = c.bars(float(total), 3)
        assert got[0].tolist() == no and got[1].tolist() == marks
        assert left(table, float(total), 3) == (after, bar)


def tape(spark, n, symbols=3, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(10) * rng.randrange(2) % symbols}", k, 100.0 + rng.randrange(50) / 4, float(rng.randrange(1, 9))) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, seq long, price double, size double")
    return rows, df.selectExpr("*", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, seq) as ts", "seq * 1000000 as ts_us")


def test_one_symbol_over_many_tasks(spark, monkeypatch):
    """Most ticks are of one symbol, and lie over a dozen slices; bars go over their edges."""
    monkeypatch.setattr(slices, "ROWS", 90)
    rows, df = tape(spark, 1000)
    assert slices.sliced(df, ["symbol"], ["seq"]).df.rdd.getNumPartitions() == 12
    for threshold in (1.0, 40.0, 700.0, 10**9):
        want = {}
        for s in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == s]
            no, marks, _, _ = plain([r[3] for r in mine], [threshold] * len(mine), [True] * len(mine))
            done = {b for b, c in zip(no, marks, strict=True) if c}
            for i, (b, r) in enumerate(zip(no, mine, strict=True)):
                if b in done:
                    o = want.setdefault((s, b), [r[2], r[2], r[2], r[2], 0, i, 0])
                    want[s, b] = [o[0], max(o[1], r[2]), min(o[2], r[2]), r[2], o[4] + r[3], i, o[6] + 1]
        got = {(r.symbol, r.bar_no): [r.open, r.high, r.low, r.close, r.volume, r.tick_num, r.num_ticks] for r in bars.volume_bars(df, threshold).collect()}
        assert got == want


def test_rules_over_slices(spark, monkeypatch):
    monkeypatch.setattr(slices, "ROWS", 50)
    rows, df = tape(spark, 400)
    df = df.selectExpr("symbol", "seq", "if(seq % 7 = 0, null, price) as price", "size")
    stage = slices.Stage
    s = slices.sliced(df, ["symbol"], ["seq"]).scan([
        stage(["price"], "rank long, last double", Seen(1)), stage(["size"], "total double", Sums(1)), stage(["price"], "top double", Tops()),
        stage(["price"], "third double", slices.Tail(1, 3, lambda x: [x[0][:-3]])),
    ])
    assert sorted(map(str, s.df.collect())) == sorted(map(str, s.df.collect())) == sorted(map(str, s.df.repartition(3, "seq").collect()))
    now = {}
    for r in sorted(s.df.collect(), key=lambda r: (r.symbol, r.seq)):
        past = now.setdefault(r.symbol, [])
        seen = [p for p, _ in past if p is not None]
        assert r["rank"] == (0 if r.price is None else len(seen) + 1)
        assert r["last"] == (seen[-1] if seen else None)
        assert r["third"] == (past[-3][0] if len(past) >= 3 else None)
        past.append((r.price, r.size))
        assert r["total"] == sum(x for _, x in past)
        assert r["top"] == max((p for p, _ in past if p is not None), default=None)
    assert slices.sliced(df.limit(0), ["symbol"], ["seq"]).scan([stage(["size"], "total double", Sums(1))]).df.collect() == []


def test_block_convolution_is_the_expanding_sum(spark, monkeypatch):
    from quantloom.operators import fracdiff

    monkeypatch.setattr(slices, "ROWS", 60)
    monkeypatch.setattr(fracdiff, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(s, k, None if (s == "a" and k < 3) or k % 11 == 5 else float(rng.standard_normal())) for s, n in (("a", 300), ("b", 17), ("c", 1)) for k in range(n)]
    rows += [("d", k, None) for k in range(4)]
    got = {(r.symbol, r.seq): r.fd for r in fracdiff.expanding(spark.createDataFrame(rows, "symbol string, seq long, x double"), "x", 0.4).collect()}
    assert len(got) == len(rows)
    for symbol in "abcd":
        mine = [r for r in rows if r[0] == symbol]
        w, past = fracdiff.expanding_weights(0.4, len(mine)), []
        total, seen, skip = sum(map(abs, w)), 0.0, 0
        for x in w:
            skip += 1 - seen / total > 0.01
            seen += abs(x)
        for _, k, x in mine:
            if x is not None or past:
                past.append(x if x is not None else past[-1])
            want = sum(a * b for a, b in zip(w, reversed(past), strict=False)) if x is not None and len(past) > skip else None
            assert got[symbol, k] == (None if want is None else pytest.approx(want, abs=1e-9))


def plain_bootstrap(spans, draws, seed):
    """Each event's uniqueness anew for every draw."""
    rng, cover, out = random.Random(seed), {}, []
    for _ in range(draws):
        u = [sum(1 / (1 + cover.get(i, 0)) for i in range(a, b + 1)) / (b - a + 1) for a, b in spans]
        k = rng.choices(range(len(spans)), u)[0]
        out.append(k)
        for i in range(spans[k][0], spans[k][1] + 1):
            cover[i] = cover.get(i, 0) + 1
    return out


@pytest.mark.parametrize(("n", "bars_", "longest"), [(1, 5, 3), (70, 40, 9), (200, 900, 30), (300, 50, 50)])
def test_the_tree_draws_what_the_plain_form_draws(n, bars_, longest):
    from quantloom.operators.weights import sequential_bootstrap

    rng = random.Random(n)
    spans = sorted((a := rng.randrange(bars_), a + rng.randrange(longest)) for _ in range(n))
    assert sequential_bootstrap(spans, n, 5) == plain_bootstrap(spans, n, 5)
    mixed = spans[:]
    rng.shuffle(mixed)
    assert sorted(mixed[k] for k in sequential_bootstrap(mixed, n, 5)) == sorted(spans[k] for k in sequential_bootstrap(spans, n, 5))


def test_a_hundred_thousand_events_are_drawn():
    """The share of each start's events, given draws so far, evens out: mean uniqueness is over that of a plain bootstrap."""
    import time

    from quantloom.operators.weights import sequential_bootstrap

    rng = np.random.default_rng(4)
    first = np.sort(rng.integers(0, 400_000, 100_000))
    spans = np.stack([first, first + rng.integers(0, 4, 100_000)], axis=1)
    began = time.time()
    drawn = spans[sequential_bootstrap(spans, 100_000, 1)]
    assert time.time() - began < 90
    plain_ = spans[rng.integers(0, 100_000, 100_000)]

    def unique(x):
        cover = np.zeros(400_050)
        np.add.at(cover, x[:, 0], 1)
        np.add.at(cover, x[:, 1] + 1, -1)
        sums = np.concatenate([[0], np.cumsum(1 / np.maximum(np.cumsum(cover), 1))])
        return ((sums[x[:, 1] + 1] - sums[x[:, 0]]) / (x[:, 1] - x[:, 0] + 1)).mean()

    assert unique(drawn) > unique(plain_) * 1.02


def test_a_chain_of_scans_runs_in_one_python_worker(spark):
    rows = [("ab"[k % 2], k, float(k % 7) + 1, float(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "symbol string, seq long, close double, kept double")
    out = indicators.recurrences(df, indicators.trix_stages("close", 3, "trix"), indicators.gain_stages("close", 4, "rsi", "rsi"), indicators.macd_stages("close", 2, 4, 3, "macd"))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert set(out.columns) == {"symbol", "seq", "close", "kept", "rsi", "macd", "trix", "macd_signal"}
    alone = indicators.with_rsi(df, 4).join(indicators.with_trix(df, 3).select("symbol", "seq", "trix"), ["symbol", "seq"])
    pick = lambda d: [(r.symbol, r.seq, r.kept, r.rsi, r.trix) for r in d.orderBy("symbol", "seq").collect()]
    assert pick(out) == pick(alone)


def test_a_set_of_all_indicators_runs_in_two_python_workers_a_task(spark):
    rows = [("a", k, 1.0 + k % 7, 2.0 + k % 7, 0.5 + k % 7, 1.5 + k % 5, 10.0 + k) for k in range(40)]
    df, _ = FS.everything(spark.createDataFrame(rows, "symbol string, seq long, open double, high double, low double, close double, volume double"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the scans of all recurrences, and the fold of the cycle's phase behind a shuffle
    assert plan.count("MapInArrow") == 2
