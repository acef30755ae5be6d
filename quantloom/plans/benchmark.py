"""The benchmark strategy: its settings (P2), and its features, labels and events from bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indicators as T
from ..operators import events, fracdiff, sizing, weights


@dataclass(frozen=True)
class Settings:
    """P2. The defaults of the strategy."""

    fast: int = 20
    slow: int = 50
    span: int = 100
    days: float = 7
    pt_sl: tuple[float, float] = (1, 2)
    min_ret: float = 0.005
    last_weight: float = 0.5
    step: float = 0.05
    classes: int = 10
    splits: int = 10
    test_folds: int = 2


def features(bars: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, list[str]]:
    """Bars (symbol, seq, ts_us, price, close) with the side of two means and, one bar later, returns, momentum, volatility and lags of the
    least differenced log close; rows that miss any are left out."""
    df = events.ma_side(bars, s.fast, s.slow).withColumn("_log", F.log("close"))
    df = fracdiff.with_least_ffd(df, "_log", out="stationary").drop("_log").persist()  # else each use repeats eleven sums of lags
    df = df.withColumn("log_ret", F.col("stationary") - T.lag("stationary"))
    cols = {f"mom{k}": F.try_divide("stationary", T.lag("stationary", k)) - 1 for k in range(1, 6)}
    cols |= {f"volatility_{n}": T.volatility("log_ret", n) for n in (10, 25, 50)} | {f"log_t{k}": T.lag("log_ret", k) for k in range(1, 6)}
    names = ["log_ret", *cols]
    return T.shifted(df.withColumns(cols), names).na.drop("any", subset=["side", "stationary", *names]), names


def benchmark(bars: DataFrame, s: Settings = Settings(), train: F.Column | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(frame, labels, names): the features' rows, and the labels of their CUSUM events (ret, bin, t1_us, trgt) under barriers without a side.

    The threshold is each symbol's mean daily volatility over the rows that ``train`` holds for, or over all rows if there is none (which
    looks ahead). Events without a volatility yet have no barrier and no label.
    """
    frame, names = features(bars, s)
    frame = frame.persist()  # read by nine branches; lost blocks are computed again
    vol = events.daily_vol(frame, s.span).persist()
    h = events.volatility_threshold(vol if train is None else vol.filter(train))
    chosen = events.cusum_events(frame.join(h, "symbol"), "h").select("symbol", "seq")
    barred = events.vertical_barrier(frame, s.days).join(chosen, ["symbol", "seq"], "left_semi")
    e = barred.join(vol.select("symbol", "seq", F.col("vol").alias("trgt")), ["symbol", "seq"]).drop("side")
    found = events.bins(events.triple_barrier(e, frame, s.pt_sl, s.min_ret), frame)
    return frame, found.select("symbol", "seq", "ts_us", "trgt", "v_us", "t1_us", "ret", "bin"), names


def sample_weights(frame: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(symbol, seq, weight): the labels' weights by returns, times their decay."""
    own = W.partitionBy("symbol").orderBy("seq")
    at = frame.select("symbol", "seq", "ts_us", "price", (F.row_number().over(own) - 1).cast("long").alias("i"))
    ends = at.select("symbol", F.col("ts_us").alias("t1_us"), F.col("i").alias("i1")).groupBy("symbol", "t1_us").agg(F.min("i1").alias("i1"))
    e = labels.join(at.select("symbol", "seq", F.col("i").alias("i0")), ["symbol", "seq"]).join(ends, ["symbol", "t1_us"], "left")
    return weights.combined(weights.weights(e, at), s.last_weight).select("symbol", "seq", "weight")


def bet_sizes(scored: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Active, discrete bet sizes of (symbol, t0, t1, prob, pred)."""
    return sizing.sized(scored, s.classes, s.step)
