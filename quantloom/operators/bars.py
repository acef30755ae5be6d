"""Bars from ticks: by time, ticks, volume and dollars, with fixed or adaptive thresholds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .slices import Arrays, Stage, Tail, numbered_bars, sliced


def aggregated(ticks: DataFrame, by: list[str], opened: str = "price", high: str = "price", low: str = "price", size: str = "size", closes: str | None = None) -> DataFrame:
    """Ticks with bar keys ``by`` as bars, with closes if any tick has it; one partial aggregate, then one shuffle."""
    more = [] if closes is None else [F.max(closes).alias(closes)]
    return ticks.groupBy(*by).agg(
        F.max_by("ts", "seq").alias("ts"), F.min_by(opened, "seq").alias("open"), F.max(high).alias("high"), F.min(low).alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum(size).alias("volume"), F.max("i").alias("tick_num"), F.count("*").alias("num_ticks"), *more,
    )


def numbered(ticks: DataFrame) -> DataFrame:
    """``ticks`` with i, the tick's place in its symbol from 0."""
    return ticks.withColumn("i", (F.row_number().over(W.partitionBy("symbol").orderBy("seq")) - 1).cast("long"))


def time_bars(ticks: DataFrame, every: str = "hour") -> DataFrame:
    """B1: bars of calendar units."""
    return aggregated(numbered(ticks).withColumn("bar", F.date_trunc(every, "ts").cast("timestamp_ntz")), ["symbol", "bar"])


def tick_bars(ticks: DataFrame, size: int, first_bar_extra: bool = True) -> DataFrame:
    """B2: bars of ``size`` ticks. With ``first_bar_extra`` the first holds one more; the last, unfinished one is not given."""
    df = numbered(ticks)
    bar = F.greatest(F.ceil(F.col("i") / size) - 1, F.lit(0)) if first_bar_extra else F.floor(F.col("i") / size)
    out = aggregated(df.withColumn("bar_no", bar.cast("long")), ["symbol", "bar_no"])
    return out.filter(F.col("num_ticks") >= F.when(F.col("bar_no") == 0, size + int(first_bar_extra)).otherwise(size))


def threshold_bars(ticks: DataFrame, measure: Column, threshold: Column | float, gate: Column | None = None, **names: str) -> DataFrame:
    """A bar closes at the tick at which the running ``measure`` reaches ``threshold`` while ``gate`` holds; the rest of the
    measure is dropped, and an unfinished bar is not given. A symbol's ticks may lie over many tasks."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    df = ticks.withColumns({"_m": measure.cast("double"), "_t": t.cast("double"), "_g": F.lit(True) if gate is None else gate})
    folded = numbered_bars(sliced(df, ["symbol"], ["seq"]), "_m", "_t", "_g")
    opened = {"opened": names.get("opened", "price"), "high": names.get("high", "price"), "low": names.get("low", "price"), "size": names.get("size", "size")}
    return aggregated(folded, ["symbol", "bar_no"], **opened, closes="closes").filter("closes").drop("closes")


def volume_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """B3."""
    return threshold_bars(ticks, F.col("size"), threshold)


def dollar_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """B4."""
    return threshold_bars(ticks, F.col("price") * F.col("size"), threshold)


def daily_fraction_bars(ticks: DataFrame, factor: float) -> DataFrame:
    """Dollar bars at ``factor`` of the symbol's mean daily turnover."""
    span = (F.max("ts_us") - F.min("ts_us")) / F.lit(86_400_000_000.0)
    t = ticks.groupBy("symbol").agg((factor * F.try_divide(F.sum(F.col("price") * F.col("size")), span)).alias("_T"))
    return threshold_bars(ticks.join(t, "symbol"), F.col("price") * F.col("size"), F.col("_T"))


def deviations(window: int) -> Callable[[Arrays], Arrays]:
    """The sample deviation of the ``window`` returns before each price, for prices with window + 1 rows before them in front."""

    def made(x: Arrays) -> Arrays:
        n = len(x[0]) - window - 1
        with np.errstate(all="ignore"):
            r = x[0][1:] / x[0][:-1] - 1
            w = np.lib.stride_tricks.sliding_window_view(r, window)[:n]
            there = ~np.isnan(w)
            count = there.sum(axis=1)
            mean = np.where(there, w, 0.0).sum(axis=1) / count
            spread = np.where(there, (w - mean[:, None]) ** 2, 0.0).sum(axis=1) / (count - 1)
            return [np.where(count > 1, np.sqrt(spread), np.nan)]

    return made


def dynamic_thresholds(ticks: DataFrame, factor: float, window: int = 50) -> DataFrame:
    """``ticks`` with _T (A.2): a tenth of the last session's turnover, over 1 - |100 sigma| of the ticks before; ``factor`` until there is a session."""
    df = sliced(ticks.withColumn("_d", F.to_date("ts")), ["symbol"], ["seq"]).scan([Stage(["price"], "_s double", Tail(1, window + 1, deviations(window)))]).df
    day = ticks.groupBy("symbol", F.to_date("ts").alias("_d")).agg(F.sum(F.col("price") * F.col("size")).alias("_pv"))
    day = day.withColumn("_prev", F.lag("_pv").over(W.partitionBy("symbol").orderBy("_d"))).drop("_pv")
    df = df.withColumn("_s", F.least(F.abs(100 * F.coalesce("_s", F.lit(0.0))), F.lit(0.95))).join(day, ["symbol", "_d"])
    return df.withColumn("_T", F.coalesce(F.col("_prev") * 0.1 / (1 - F.col("_s")), F.lit(float(factor)))).drop("_d", "_s", "_prev")


def dynamic_bars(ticks: DataFrame, factor: float, window: int = 50, session: Column | None = None, emit: Column | None = None) -> DataFrame:
    """Volatility-adaptive dollar bars without look-ahead; ``session`` keeps ticks (B10), ``emit`` gates closing only."""
    df = ticks if session is None else ticks.filter(session)
    return threshold_bars(dynamic_thresholds(df, factor, window), F.col("price") * F.col("size"), F.col("_T"), emit)


def dynamic_second_bars(seconds: DataFrame, factor: float, window: int = 50) -> DataFrame:
    """As B8 over second aggregates with their own open, high and low."""
    df = dynamic_thresholds(seconds.withColumn("size", F.col("volume")), factor, window)
    return threshold_bars(df, F.col("price") * F.col("size"), F.col("_T"), opened="open", high="high", low="low")


def business_day(ts: str = "ts") -> Column:
    """The business day that a time counts to: Saturday and Sunday to Friday."""
    d = F.to_date(ts)
    return F.date_sub(d, F.greatest(F.lit(0), F.weekday(d) - 4))


def calendar_bars(ticks: DataFrame) -> DataFrame:
    """Bars of business days."""
    return aggregated(numbered(ticks).withColumn("day", business_day()), ["symbol", "day"])


def daily_last(ticks: DataFrame) -> DataFrame:
    """Each calendar day's last price, null on days without ticks."""
    day = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("price", "seq").alias("close"))
    days = day.groupBy("symbol").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(day, ["symbol", "day"], "left")
