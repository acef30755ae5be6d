"""Hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalar as S
from quantloom.operators import bars, events, fracdiff, pairs, sizing, splits, weights
from quantloom.sources import tape

TICKS = [(100, 3), (101, 2), (99, 5), (102, 4), (103, 1), (101, 6), (98, 2), (97, 7)]
CLOSES = [100, 101, 99, 97, 103, 104]
DAY = 86_400_000_000


def ticks(spark, rows=TICKS, symbol="a"):
    df = spark.createDataFrame([(symbol, i, float(p), s) for i, (p, s) in enumerate(rows)], "symbol string, seq long, price double, size long")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(seq)")).withColumn("ts_us", F.col("seq") * DAY)


def prices(spark, closes):
    return ticks(spark, [(c, 1) for c in closes])


def shape(df):
    return [(r.open, r.high, r.low, r.close, r.volume, r.num_ticks) for r in df.orderBy("symbol", "bar_no").collect()]


THREE = [(100, 101, 99, 99, 10, 3), (102, 103, 101, 101, 11, 3), (98, 98, 97, 97, 9, 2)]


def test_bars(spark):
    t = ticks(spark)
    assert shape(bars.dollar_bars(t, 800)) == THREE
    assert shape(bars.volume_bars(t, 9)) == THREE
    got = bars.tick_bars(t, 3).orderBy("bar_no").collect()
    assert [(r.bar_no, r.tick_num, r.num_ticks) for r in got] == [(0, 3, 4), (1, 6, 3)]
    assert bars.dollar_bars(t, 1e12).count() == 0
    two = t.union(ticks(spark, symbol="b"))
    assert shape(bars.dollar_bars(two, 800)) == THREE + THREE
    assert bars.dollar_bars(t.limit(0), 800).count() == 0


def test_duplicate_times_move_by_a_millisecond(spark):
    df = spark.createDataFrame([("a", k) for k in range(3)], "symbol string, seq long").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert [r.ts.microsecond for r in tape.unique_times(df).orderBy("seq").collect()] == [0, 1000, 2000]


def test_session_edges_and_daylight_saving(spark):
    times = ["2024-01-05 14:30:00", "2024-01-05 21:00:00", "2024-01-05 21:00:00.000001", "2024-07-05 13:30:00", "2024-07-05 13:29:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert [r.x for r in df.select(tape.in_session().alias("x")).collect()] == [True, True, False, True, False]
    assert [r.x for r in df.select(tape.in_session(inclusive=False).alias("x")).collect()] == [False] * 5


def test_cusum(spark):
    got = events.cusum_events(prices(spark, [100, 101, 103, 102, 99, 98, 100, 104]), 0.025)
    assert sorted(r.seq for r in got.collect()) == [4, 7]


@pytest.mark.parametrize(("side", "pt", "sl"), [(1.0, 4, None), (-1.0, 3, 5)])
def test_triple_barrier(spark, side, pt, sl):
    b = prices(spark, CLOSES)
    e = b.filter("seq = 0").withColumns({"v_us": F.lit(5 * DAY), "trgt": F.lit(0.02), "side0": F.lit(side)})
    r = events.triple_barrier(e, b, (1, 2), side="side0").first()
    assert (r.pt_us, r.sl_us) == (pt * DAY, sl and sl * DAY) and r.t1_us == min(x * DAY for x in (pt, sl, 5) if x)


def test_weights_and_decay(spark):
    b = prices(spark, CLOSES).withColumn("i", F.col("seq"))
    e = spark.createDataFrame([("a", 0, 2), ("a", 2, 3), ("a", 4, 5)], "symbol string, i0 long, i1 long")
    assert [r.c for r in weights.concurrency(e, b).orderBy("i").collect()] == [1, 1, 2, 1, 1, 1]
    got = weights.decay(weights.decay(weights.weights(e, b), 0.5, out="a"), -0.5, out="b").orderBy("i0").collect()
    for r, tw, raw, w, a, c in zip(got, (0.833333, 0.75, 1), (5.00025e-05, 0.0304092, 0.0696799), (0.00149799, 0.911009, 2.087493), (0.661290, 0.806452, 1), (0, 0.225806, 1), strict=True):
        assert (r.tw, r.w_raw, r.w, r.a, r.b) == pytest.approx((tw, raw, w, a, c), rel=1e-5, abs=1e-9)
    with pytest.raises(ValueError):
        weights.decay(e, -1)


def test_sequential_bootstrap_is_seeded_and_whole():
    spans = [(0, 2), (2, 3), (4, 5)]
    a, b = weights.sequential_bootstrap(spans, 50, 3), weights.sequential_bootstrap(spans, 50, 3)
    assert a == b and set(a) <= {0, 1, 2} and len(a) == 50


def test_fractional_differences(spark):
    assert fracdiff.ffd_weights(0.4, 0.1) == pytest.approx([1, -0.4, -0.12])
    assert fracdiff.ffd_weights(1, 0.1) == [1, -1] and fracdiff.ffd_weights(0, 0.1) == [1]
    assert [len(fracdiff.ffd_weights(k / 10, 0.01)) - 1 for k in range(11)] == [0, 7, 10, 11, 10, 9, 8, 6, 5, 3, 1]
    df = prices(spark, [1, 2, 4, 7, 11])
    assert [r.ffd for r in fracdiff.with_ffd(df, "price", 0.4, 0.1).orderBy("seq").collect()] == [None, None, *map(pytest.approx, (3.08, 5.16, 7.72))]
    long = fracdiff.with_ffd(prices(spark, list(range(1, 101))), "price", 0.4, 1e-3)
    w = fracdiff.ffd_weights(0.4, 1e-3)
    last = long.orderBy(F.col("seq").desc()).first().ffd
    assert last == pytest.approx(sum(x * (100 - k) for k, x in enumerate(w)))


def test_critical_values_and_p_values(spark):
    for n, c in ((2525, -2.862685340), (2520, -2.862687614), (2516, -2.862689439)):
        assert spark.range(1).select(fracdiff.adf_critical(F.lit(float(n))).alias("c")).first().c == pytest.approx(c, abs=1e-8)
    assert fracdiff.adf_p_value(-3.0398) == pytest.approx(0.0313, abs=1e-4)
    flat = prices(spark, [5] * 20)
    assert fracdiff.adf(flat, "price", ["symbol"]).first().adf_stat is None


def test_bet_sizes(spark):
    df = spark.createDataFrame([(0.6, 1), (0.75, -1), (0.9, 1), (1.0, -1)], "p double, y int")
    s = S.signal(F.col("p"), F.col("y"))
    got = df.select(s.alias("s"), S.discrete(s).alias("d")).collect()
    assert [r.s for r in got] == pytest.approx([0.161744, -0.436297, 0.817578, -1], abs=1e-6)
    assert [r.d for r in got] == pytest.approx([0.15, -0.45, 0.8, -1])
    w = S.calibrated_w(F.lit(10.0), F.lit(0.95))
    r = spark.range(1).select(w.alias("w"), S.target_position(w, F.lit(115.0), F.lit(100.0), F.lit(100)).alias("t"), S.limit_price(F.lit(97), F.lit(0), F.lit(115.0), w, F.lit(100)).alias("l")).first()
    assert (r.w, r.t, r.l) == (pytest.approx(10.803324, abs=1e-6), 97, pytest.approx(112.365739, abs=1e-6))


def test_active_signals(spark):
    df = spark.createDataFrame([("a", 0, 3, 0.6), ("a", 1, 4, -0.2), ("a", 3, None, 0.4)], "symbol string, t0 long, t1 long, signal double")
    assert {r.t: round(r.signal, 9) for r in sizing.active_signals(df).collect()} == {0: 0.6, 1: 0.2, 3: 0.1, 4: 0.4}


def rows(spark, n=12):
    return spark.createDataFrame([("a", i, i, min(i + 2, n - 1)) for i in range(n)], "symbol string, pos long, pred long, eval long")


def train(df, split):
    return sorted(r.pos for r in df.filter((F.col("split") == split) & (F.col("role") == "train")).collect())


def test_splits(spark):
    assert train(splits.purged_kfold(rows(spark), 3, 0.1), 1) == [0, 1, 2, 10, 11]
    assert splits.cpcv_splits(4, 2) == [[0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]
    paths = {}
    for r in splits.cpcv_paths(spark, 4).orderBy("group", "path").collect():
        paths.setdefault(r.group, []).append(r.split)
    assert list(paths.values()) == [[0, 1, 2], [0, 3, 4], [1, 3, 5], [2, 4, 5]]
    # one test block [3, 6) with an embargo of 1
    assert train(splits.cpcv(rows(spark), 4, 1, 1), 1) == [0, 9, 10, 11]
    with pytest.raises(ValueError):
        splits.cpcv(rows(spark), 1, 1)


def test_train_never_overlaps_test(spark):
    r = splits.cpcv(rows(spark, 30), 5, 2, 0).join(rows(spark, 30), ["symbol", "pos"])
    a, b = r.filter("role = 'train'").alias("a"), r.filter("role = 'test'").alias("b")
    met = a.join(b, (F.col("a.split") == F.col("b.split")) & (F.col("a.pred") <= F.col("b.pred")) & (F.col("a.eval") >= F.col("b.pred")))
    assert met.count() == 0


def test_position_machine(spark):
    z = [-0.2, -0.8, -0.5, 0.1, 0.9, 0.4, -0.1, -0.9]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(z)], "pair string, seq long, z double")
    assert [r.position for r in pairs.positions(df).orderBy("seq").collect()] == [0, 1, 1, 0, -1, -1, 0, 1]


def test_ewm_std_matches_its_definition(spark):
    x = [math.sin(k) for k in range(40)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "symbol string, seq long, r double")
    got = [r.vol for r in events.ewm_std(df, "r", 10).orderBy("seq").collect()]
    assert got[0] is None
    keep, n = 1 - 2 / 11, len(x)
    w = [keep ** (n - 1 - k) for k in range(n)]
    s, s2 = sum(w), sum(v * v for v in w)
    m = sum(a * b for a, b in zip(w, x, strict=True)) / s
    assert got[-1] == pytest.approx(math.sqrt(sum(a * (b - m) ** 2 for a, b in zip(w, x, strict=True)) / s * s * s / (s * s - s2)))


def test_trades_from_csv_become_bars(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sip_timestamp,price,size\n" + "".join(f"{1_700_000_000_000_000_000 + k * 1_000_000_000},{p},{v}\n" for k, (p, v) in enumerate(((100, 3), (101, 2), (99, 5), (102, 4), (103, 1), (101, 6), (98, 2), (97, 7)))))
    ticks = tape.read_trades(spark, str(tmp_path / "t.csv"), "x")
    got = bars.dollar_bars(ticks, 800.0).orderBy("bar_no").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(100, 101, 99, 99, 10), (102, 103, 101, 101, 11), (98, 98, 97, 97, 9)]
    out = str(tmp_path / "bars")
    tape.write_bars(bars.dollar_bars(ticks, 800.0), out)
    assert spark.read.option("header", True).csv(out).count() == 3


def test_paths_and_splits_have_the_same_numbers(spark):
    made = splits.cpcv_splits(5, 2)
    assert all(r.group in made[r.split] for r in splits.cpcv_paths(spark, 5).collect())
