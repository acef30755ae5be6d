"""Sides and labels at values where rounding shows."""

import math

import duckdb
import pytest

from quantloom.operators import events


def test_equal_means_are_equal_whatever_their_sums(spark):
    """Both means of a constant price are it; as running sums of floats, that of 50 prices is greater than that of 20."""
    price = 0.0005
    df = spark.createDataFrame([("a", k, price) for k in range(60)], "symbol string, seq long, price double")
    got = [r.side for r in events.ma_side(df).orderBy("seq").collect()]
    assert got == [None] * 50 + [1] * 10


def test_crossings_of_either_side_try_the_rest_of_a_block_alone(spark):
    prices = [100 + 10 * math.sin(k / 9) + (k * 37 % 11) / 5 for k in range(300)]
    bars = spark.createDataFrame([("a", k, 10 * k, p) for k, p in enumerate(prices)], "symbol string, i long, ts_us long, price double")
    asks = [("a", a, min(300, a + 150), prices[a], side, above, 0.06 if above else -0.04) for a in (0, 63, 64, 130, 255) for side in (1.0, -1.0) for above in (True, False)]
    asked = spark.createDataFrame(asks, "symbol string, a long, b long, base double, side double, above boolean, bar double")
    out = events.first_crossings(asked, events.extremes(bars))
    assert "slice(children" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a, r.side, r.above): r.hit_us for r in out.collect()}
    for _, a, b, base, side, above, bar in asks:
        rets = [(k, (prices[k] / base - 1) * side) for k in range(a, b)]
        assert got[a, side, above] == next((10 * k for k, r in rets if (r > bar if above else r < bar)), None)


def test_crossings_from_a_price_of_zero(spark):
    prices = [0.0 if k in (0, 70, 71, 140) else 5.0 + k % 3 for k in range(200)]
    bars = spark.createDataFrame([("a", k, 10 * k, p) for k, p in enumerate(prices)], "symbol string, i long, ts_us long, price double")
    asks = [("a", a, 200, 0.0, side, above, 0.06 if above else -0.04) for a in (1, 70, 71, 141) for side in (1.0, -1.0) for above in (True, False)]
    asked = spark.createDataFrame(asks, "symbol string, a long, b long, base double, side double, above boolean, bar double")
    got = {(r.a, r.side, r.above): r.hit_us for r in events.first_crossings(asked, events.extremes(bars)).collect()}
    for _, a, b, _, side, above, _ in asks:
        # no number is above everything, an infinity above or below by its side
        hits = (k for k in range(a, b) if (above if not prices[k] else above == (side > 0)))
        assert got[a, side, above] == next((10 * k for k in hits), None)


@pytest.mark.parametrize("name", ["triple_barrier", "labels", "meta_labels"])
def test_barriers_of_events_at_a_price_of_zero(spark, tmp_path, name):
    """A long tape's price may round to 0: returns on it are infinite, or no number, as in SQL."""
    from quantloom.plans.queries import QUERIES, SQL

    c = duckdb.connect()
    # down to 0 at the 10th and 40th event, back at the 20th, up again by tiny steps
    value = "case when k in (10, 40) then -400000 when k = 20 then 400000 else 50 + (k * 37 % 11 - 5) * 40 end"
    rows = f"select cast(k * 2 + s as bigint) as event_id, timestamp '2024-01-01' + to_hours(cast(5 * k as int)) as ts, 1::bigint as user_id, ['a', 'b'][s + 1] as event_type, cast({value} as double) as value, '{{\"k\": ' || (k * 7 % 5) || '}}' as props from range(60) as q(k), range(2) as r(s)"
    c.execute(f"copy ({rows}) to '{tmp_path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    r = c.execute(SQL[name])
    names = [x[0] for x in r.description]
    told = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    want = sorted(tuple(map(told, x)) for x in r.fetchall())
    assert sorted(tuple(told(x[n]) for n in names) for x in df.collect()) == want
    if name == "meta_labels":
        assert "nan" in {x[names.index("ret")] for x in want}
