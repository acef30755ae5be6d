"""Sampling of events (E1-E4) and labels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..session import cut
from .fold import ordered_fold
from .slices import Affine, Arrays, Stage, Sums, sliced

DAY = 86_400_000_000


def daily_return(bars: DataFrame, back: int = DAY) -> DataFrame:
    """The return against the last bar strictly before ts - ``back`` microseconds; bars without one are left out."""
    w = W.partitionBy("symbol").orderBy("ts_us").rangeBetween(W.unboundedPreceding, -(back + 1))
    return bars.withColumn("partner", F.last("price").over(w)).filter("partner is not null").withColumn("ret", F.col("price") / F.col("partner") - 1)


def ewm_stage(value: str, span: int, out: str) -> Stage:
    """E2 as a stage of a scan: sums of weights, of squared weights, of weighted values and of weighted squares decay alike."""
    keep = 1 - 2 / (span + 1)

    def maps(x: Arrays) -> tuple[np.ndarray, np.ndarray]:
        there = ~np.isnan(x[0])
        v, one = np.where(there, x[0], 0.0), there.astype(np.float64)
        a = np.where(there, np.array([[keep], [keep * keep], [keep], [keep]]), 1.0)
        return a, np.stack([one, one, v, v * v])

    def finish(x: Arrays, y: np.ndarray, before: np.ndarray) -> Arrays:
        w, w2, wx, wxx = y
        spare = w * w - w2
        out = np.sqrt(np.maximum(0.0, wxx / w - (wx / w) ** 2) * w * w / spare)
        return [np.where((spare > 1e-12) & ~np.isnan(x[0]), out, np.nan)]

    return Stage([value], f"{out} double", Affine(4, maps, finish))


def ewm_std(df: DataFrame, value: str, span: int = 100, out: str = "vol") -> DataFrame:
    """Exponentially weighted deviation, adjusted and bias-corrected; null for a symbol's first value, and where there is none."""
    return sliced(df, ["symbol"], ["seq"]).scan([ewm_stage(value, span, out)]).df


def daily_vol(bars: DataFrame, span: int = 100) -> DataFrame:
    """E1 and E2."""
    return ewm_std(daily_return(bars), "ret", span)


def volatility_threshold(vols: DataFrame) -> DataFrame:
    """(symbol, h): the mean of vol over ``vols``, which should hold the training range alone, so that a threshold knows nothing of what follows."""
    return vols.groupBy("symbol").agg(F.avg("vol").alias("h"))


def cusum_events(bars: DataFrame, h: float | str) -> DataFrame:
    """Bars at which the symmetric CUSUM of log price changes passes ``h``, a number or a column; the first change is skipped, only the side
    that passes is reset. Without a threshold nothing passes."""

    def start() -> Callable[..., tuple]:
        last, n, up, down = None, 0, 0.0, 0.0

        def step(p: float | None, h: float | None) -> tuple:
            nonlocal last, n, up, down
            if p is None or h is None:
                return (False,)
            x = math.log(p)
            n += 1
            if n <= 2:
                last = x
                return (False,)
            d, last = x - last, x
            up, down = max(0.0, up + d), min(0.0, down + d)
            if down < -h:
                down = 0.0
                return (True,)
            if up > h:
                up = 0.0
                return (True,)
            return (False,)

        return step

    df = bars.withColumn("_h", F.col(h) if isinstance(h, str) else F.lit(float(h)))
    return ordered_fold(df, ["symbol"], ["seq"], ["price", "_h"], "event boolean", start).filter("event").drop("event", "_h")


def vertical_barrier(bars: DataFrame, days: float = 1) -> DataFrame:
    """L1: ``bars`` with v_us, the time of the first bar at or after ts + ``days``; null if there is none."""
    w = W.partitionBy("symbol").orderBy(F.col("ts_us").desc()).rangeBetween(W.unboundedPreceding, -int(days * DAY))
    return bars.withColumn("v_us", F.last("ts_us").over(w))


#: Children of a node of the hierarchy of extremes.
CHILDREN = 64
#: Levels of so many nodes at most are broadcast: a node has CHILDREN pairs of numbers.
SMALL = 4096


def extremes(bars: DataFrame) -> list[DataFrame]:
    """The hierarchy over ``bars`` (symbol, i, ts_us, price): per level (symbol, node, children), each a block of CHILDREN nodes of the level below.

    Children are an array of (at, lo, hi): the place in the block, least and greatest price; of bars also their time. Every level has
    one row a block, and the last one a row a symbol.
    """
    now = bars.select("symbol", F.col("i").alias("at"), F.col("price").alias("lo"), F.col("price").alias("hi"), F.col("ts_us").alias("t"))
    levels = []
    while True:
        node = F.expr(f"at div {CHILDREN}")
        child = F.struct((F.col("at") % CHILDREN).cast("int").alias("at"), "lo", "hi", "t")
        up = cut(now.groupBy("symbol", node.alias("node")).agg(F.array_sort(F.collect_list(child)).alias("children"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        levels.append(up.select("symbol", "node", "children"))
        if not up.filter("node > 0").limit(1).count():
            return levels
        now = up.select("symbol", F.col("node").alias("at"), "lo", "hi", F.lit(None).cast("long").alias("t"))


def first_crossings(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``asked`` (symbol, a, b, base, side, bar, above, ...) with hit_us: the time of the first bar from place a on, before b, whose return
    (price / base - 1) * side is over ``bar``, or under it where ``above`` is false; null if there is none.

    A return grows or falls with the price, so a block has a crossing if and only if its greatest price crosses, or its least, by the signs of
    side and base and the barrier asked for: one price is tried a child, and of a block only the children from the start on. The search
    climbs from a's block as long as what is left of a block has none, and then goes down into the first child that has one: at most two
    lookups a level, of one block each.
    """
    def crosses(child: Column) -> Column:
        # a price that is no number is the greatest, and above everything; so is the return of 0 on 0
        high = F.col("_high") | (F.col("above") & F.isnan(child["hi"]))
        price = F.when(high, child["hi"]).otherwise(child["lo"])
        ret = (ratio(price, F.col("base")) - 1) * F.col("side")
        return F.when(F.col("above"), ret > F.col("bar")).otherwise(ret < F.col("bar"))

    def looked(df: DataFrame, level: int, start: Column, active: Column) -> DataFrame:
        """With ``found``: the first child of the node that ``q`` lies in, at or after ``start`` in it, with a crossing; for active rows."""
        table = levels[level].select(F.col("symbol").alias("_s"), F.col("node").alias("_n"), "children")
        table = F.broadcast(table) if table.count() <= SMALL else table
        # rows that do not ask are dealt out by numbers that no node has
        key = F.when(active, F.expr(f"q div {CHILDREN}")).otherwise(-1 - F.pmod(F.xxhash64("a", "b", "base"), F.lit(1000)))
        df = df.withColumn("_k", key).withColumn("_from", start).join(table, (F.col("symbol") == F.col("_s")) & (F.col("_k") == F.col("_n")), "left")
        # children stand at their places, as these have no gaps
        hit = F.filter(F.slice("children", F.col("_from").cast("int") + 1, F.lit(CHILDREN)), crosses)
        return df.withColumn("found", F.get(hit, F.lit(0))).drop("_k", "_from", "_s", "_n", "children")

    # q: the next place to look at on the level; at: the level on which a crossing block is known, -1 for a bar, null while climbing
    df = asked.withColumns({"q": F.col("a"), "at": F.lit(None).cast("int"), "hit_us": F.lit(None).cast("long")})
    df = df.withColumn("_high", F.col("above") == ((F.col("side") >= 0) == (F.col("base") >= 0)))
    for level in range(len(levels)):
        active = F.col("at").isNull() & (F.col("q") * F.lit(CHILDREN**level) < F.col("b"))
        df = looked(df, level, F.col("q") % CHILDREN, active)
        there = F.col("found").isNotNull()
        place = F.expr(f"q div {CHILDREN}") * CHILDREN + F.col("found.at")
        df = df.withColumns({
            "at": F.when(there, F.lit(level - 1)).when(active, F.lit(None)).otherwise(F.col("at")),
            "q": F.when(there, place).when(active, F.expr(f"q div {CHILDREN}") + 1).otherwise(F.col("q")),
            "hit_us": F.when(there & (F.lit(level) == 0) & (place < F.col("b")), F.col("found.t")).otherwise(F.col("hit_us")),
        }).drop("found")
    for level in range(len(levels) - 2, -1, -1):
        active = F.col("at") == level
        # q is a node of this level now: its children are looked through from the first
        df = looked(df.withColumn("q", F.when(active, F.col("q") * CHILDREN).otherwise(F.col("q"))), level, F.lit(0), active)
        there = F.col("found").isNotNull()
        place = F.col("q") + F.col("found.at")
        df = df.withColumns({
            "at": F.when(there, F.lit(level - 1)).otherwise(F.col("at")), "q": F.when(there, place).otherwise(F.col("q")),
            "hit_us": F.when(there & (F.lit(level) == 0) & (place < F.col("b")), F.col("found.t")).otherwise(F.col("hit_us")),
        }).drop("found")
    return df.drop("q", "at", "_high")


def touches(events: DataFrame, bars: DataFrame, up: float, down: float) -> DataFrame:
    """L3: events (symbol, seq, ts_us, price, v_us, trgt, side) with pt_us and sl_us, the first times at which the return passes a barrier.

    The path runs from the event to v_us, or to the last bar, both in; a barrier with a factor of 0 or less is off. Bars are numbered by
    time over slices, with the ends of the paths among them; a hierarchy of block extremes is searched for the first crossing. So
    the work is events times log(bars), whatever a path's length, and no task holds more than a block or a slice.
    """
    none = lambda kind: F.lit(None).cast(kind)
    last = bars.groupBy("symbol").agg(F.max("ts_us").alias("_end"))
    e = cut(events.join(last, "symbol").select("symbol", "seq", "ts_us", F.coalesce("v_us", "_end").alias("to"), F.col("price").cast("double").alias("base"), F.col("side").cast("double").alias("side"), F.col("trgt").cast("double").alias("trgt")))
    marks = lambda c, k: e.select("symbol", F.col(c).alias("t"), F.lit(k).alias("k"), "seq", none("double").alias("price"), F.lit(0.0).alias("one"))
    rows = bars.select("symbol", F.col("ts_us").alias("t"), F.lit(1).alias("k"), "seq", F.col("price").cast("double").alias("price"), F.lit(1.0).alias("one"))
    # starts stand before the bars of their time, ends behind them
    placed = cut(sliced(rows.union(marks("ts_us", 0)).union(marks("to", 2)), ["symbol"], ["t", "k", "seq"]).scan([Stage(["one"], "n long", Sums(1, np.int64))]).df)
    levels = extremes(placed.filter("k = 1").select("symbol", (F.col("n") - 1).alias("i"), F.col("t").alias("ts_us"), "price"))
    ends = placed.filter("k <> 1").groupBy("symbol", "seq").agg(F.max(F.when(F.col("k") == 0, F.col("n"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("n"))).alias("b"))
    asked = e.join(ends, ["symbol", "seq"])
    sides = [F.struct(F.lit(True).alias("above"), (up * F.col("trgt")).alias("bar"))] * (up > 0) + [F.struct(F.lit(False).alias("above"), (-down * F.col("trgt")).alias("bar"))] * (down > 0)
    if not sides:
        return events.withColumns({"pt_us": none("long"), "sl_us": none("long")})
    asked = asked.select("symbol", "seq", "a", "b", "base", "side", F.explode(F.array(*sides)).alias("x")).select("symbol", "seq", "a", "b", "base", "side", "x.above", "x.bar")
    hit = first_crossings(asked, levels)
    hit = hit.groupBy("symbol", "seq").agg(F.max(F.when(F.col("above"), F.col("hit_us"))).alias("pt_us"), F.max(F.when(~F.col("above"), F.col("hit_us"))).alias("sl_us"))
    return events.join(hit, ["symbol", "seq"], "left")


def triple_barrier(events: DataFrame, bars: DataFrame, pt_sl: tuple[float, float] = (1, 1), min_ret: float = 0.0, side: str | None = None) -> DataFrame:
    """L2: events with trgt over ``min_ret`` and t1_us, the first of the barriers; without ``side`` both barriers have the first factor."""
    e = events.filter(F.col("trgt") > min_ret).withColumn("side", F.lit(1.0) if side is None else F.col(side).cast("double"))
    up, down = (pt_sl[0], pt_sl[0]) if side is None else pt_sl
    return touches(e, bars, up, down).withColumn("t1_us", F.least("v_us", "pt_us", "sl_us"))


def first_at_or_after(rows: DataFrame, bars: DataFrame, time: str, out: str) -> DataFrame:
    """``rows`` with the price of the first bar at or after ``time``: an as-of lookup by one union and a window."""
    asked = rows.select("symbol", F.col(time).alias("_t")).filter("_t is not null").distinct()
    both = asked.select("symbol", "_t", F.lit(None).cast("double").alias("_p")).union(bars.select("symbol", F.col("ts_us"), "price"))
    w = W.partitionBy("symbol").orderBy(F.col("_t").desc()).rangeBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_p", ignorenulls=True).over(w)).filter("_p is null").select("symbol", F.col("_t").alias(time), F.col("_f").alias(out)).distinct()
    return rows.join(found, ["symbol", time], "left")


def bins(events: DataFrame, bars: DataFrame, meta: bool = False) -> DataFrame:
    """L4: ret and bin of events with a t1_us; under ``meta`` the return is times side, and bin 0 if it is 0 or less, else 1.

    On a price of 0 a return is infinite, or no number (0 on 0), which has no sign and is over 0."""
    e = first_at_or_after(events.filter("t1_us is not null"), bars, "t1_us", "_p1")
    ret = ratio(F.col("_p1"), F.col("price")) - 1
    if meta:
        e = e.withColumn("ret", ret * F.col("side"))
        return e.withColumn("bin", F.when(F.col("ret") <= 0, 0).when(F.col("ret") > 0, 1)).drop("_p1")
    return e.withColumn("ret", ret).withColumn("bin", F.when(F.isnan("ret"), 0).otherwise(F.signum("ret")).cast("int")).drop("_p1")


def drop_labels(labels: DataFrame, min_share: float = 0.05) -> DataFrame:
    """The rarest label goes while its share is at most ``min_share`` and three or more are left."""
    while True:
        counts = sorted(labels.groupBy("bin").count().collect(), key=lambda r: (r["count"], r["bin"]))
        if len(counts) < 3 or counts[0]["count"] / sum(r["count"] for r in counts) > min_share:
            return labels
        labels = labels.filter(F.col("bin") != counts[0]["bin"])


def ma_side(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """1 if the fast mean is at least the slow one, -1 if not, null before there are ``slow`` bars; then one bar later. Means are told apart
    to nine digits, so that equal ones are equal in whatever order their prices are summed."""
    own = W.partitionBy("symbol").orderBy("seq")
    mean = lambda n: F.when(F.count("price").over(own.rowsBetween(-(n - 1), 0)) == n, F.round(F.avg("price").over(own.rowsBetween(-(n - 1), 0)), 9))
    side = F.when(mean(fast) >= mean(slow), 1).when(mean(fast) < mean(slow), -1)
    return bars.withColumn("_side", side).withColumn("side", F.lag("_side").over(own)).drop("_side")
