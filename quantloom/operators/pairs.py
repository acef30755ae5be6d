"""Pairs trading (Q1-Q9)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indicators import ema_stages, recurrences
from .fold import ordered_fold


def align(a: DataFrame, b: DataFrame, every_us: int = 3_600_000_000) -> DataFrame:
    """Q1: (pair, seq, t, y1, y2): prices of two tapes (pair, seq, ts_us, price) at the nearest steps of time; of several the last."""

    def at(df: DataFrame, name: str) -> DataFrame:
        t = F.round(F.col("ts_us") / every_us).cast("long") * every_us
        return df.groupBy("pair", t.alias("t")).agg(F.max_by("price", "seq").alias(name))

    both = at(a, "y1").join(at(b, "y2"), ["pair", "t"])
    return both.withColumn("seq", (F.row_number().over(W.partitionBy("pair").orderBy("t"))).cast("long"))


def ols_hedge(y: DataFrame, share: float = 0.3) -> DataFrame:
    """Q2: (pair, mu0, gamma0): y1 on y2 over the first ``share`` of the rows."""
    n = F.count("*").over(W.partitionBy("pair"))
    head = y.withColumn("_n", n).filter(F.col("seq") <= F.rint(share * F.col("_n")))
    return head.groupBy("pair").agg(F.regr_intercept("y1", "y2").alias("mu0"), F.regr_slope("y1", "y2").alias("gamma0"))


def _backfill(df: DataFrame, names: list[str]) -> DataFrame:
    w = W.partitionBy("pair").orderBy(F.col("seq").desc()).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in names})


def kalman_hedge(y: DataFrame, smooth: int = 30, q: float = 1e-5, h: float = 1e-3) -> DataFrame:
    """Q3: y with mu and gamma, filtered in a two-state random walk from Q2, then averaged over ``smooth`` rows and filled back."""
    df = y.join(ols_hedge(y), "pair")

    def start():
        mu = gamma = None
        p = [q, 0.0, q]

        def step(y1, y2, mu0, gamma0):
            nonlocal mu, gamma
            if mu is None:
                mu, gamma = mu0, gamma0
            a, b = p[0] + p[1] * y2, p[1] + p[2] * y2
            s = a + b * y2 + h
            k0, k1 = a / s, b / s
            e = y1 - mu - gamma * y2
            mu, gamma = mu + k0 * e, gamma + k1 * e
            p[0], p[1], p[2] = p[0] - k0 * a + q, p[1] - k0 * b, p[2] - k1 * b + q
            return mu, gamma

        return step

    df = ordered_fold(df, ["pair"], ["seq"], ["y1", "y2", "mu0", "gamma0"], "mu double, gamma double", start)
    w = W.partitionBy("pair").orderBy("seq").rowsBetween(-(smooth - 1), 0)
    full = F.count("*").over(w) == smooth
    df = df.withColumns({c: F.when(full, F.avg(c).over(w)) for c in ("mu", "gamma")})
    return _backfill(df, ["mu", "gamma"])


def spread(df: DataFrame) -> DataFrame:
    """Q4: weights (1, -gamma) / (1 + gamma) and the spread less mu / (1 + gamma)."""
    g = 1 + F.col("gamma")
    df = df.withColumn("w1", F.try_divide(F.lit(1.0), g)).withColumn("w2", F.try_divide(-F.col("gamma"), g))
    return df.withColumn("spread", F.col("w1") * F.col("y1") + F.col("w2") * F.col("y2") - F.try_divide("mu", g))


def z_score(df: DataFrame, n: int = 120) -> DataFrame:
    """Q5: the spread's distance from its EMA in exponential deviations, each EMA filled back."""

    def mean(x: str, out: str, frame: DataFrame) -> DataFrame:
        return _backfill(recurrences(frame, ema_stages(x, n, out), by="pair"), [out])

    df = mean("spread", "_m", df).withColumn("_e", F.col("spread") - F.col("_m")).withColumn("_e2", F.col("_e") * F.col("_e"))
    return mean("_e2", "_v", df).withColumn("z", F.try_divide("_e", F.sqrt("_v"))).drop("_m", "_e", "_e2", "_v")


def positions(df: DataFrame, long: float = -0.7, short: float = 0.7) -> DataFrame:
    """Q6: from flat to 1 at z <= long, to -1 at z >= short; back when z crosses 0."""

    def start():
        now = 0

        def step(z):
            nonlocal now
            if z is None:
                return (now,)
            if now == 0:
                now = 1 if z <= long else -1 if z >= short else 0
            elif now == 1 and z >= 0 or now == -1 and z <= 0:
                now = 0
            return (now,)

        return step

    return ordered_fold(df, ["pair"], ["seq"], ["z"], "position int", start)


def best_threshold(df: DataFrame, points: int = 50, smoothing: float = 1.0) -> dict[str, float]:
    """Q8: for each pair the threshold of most profit: the shares of z above a grid, smoothed, times the threshold.

    One aggregate of conditional counts; the solve is of the grid's size.
    """
    top = df.groupBy("pair").agg(F.max("z").alias("top"))
    grid = df.join(top, "pair")
    shares = [F.avg((F.col("z") > F.col("top") * (k / (points - 1))).cast("double")).alias(f"f{k}") for k in range(points)]
    out = {}
    d = np.zeros((points - 1, points))
    d[np.arange(points - 1), np.arange(points - 1)] = 1
    d[np.arange(points - 1), np.arange(1, points)] = -1
    for r in grid.groupBy("pair").agg(F.max("top").alias("top"), *shares).collect():
        s = np.linspace(0, r.top if r.top is not None and math.isfinite(r.top) else 0.0, points)
        f = np.linalg.solve(np.eye(points) + smoothing * d.T @ d, np.array([r[f"f{k}"] or 0.0 for k in range(points)]))
        out[r.pair] = float(s[int((s * f).argmax())])
    return out


def strategy(y: DataFrame, threshold: float = 0.7, smooth: int = 30, n: int = 120) -> DataFrame:
    """Q7, Q9: signal (the position of the row before), weights, spread and the spread's return under the signal."""
    df = positions(z_score(spread(kalman_hedge(y, smooth)), n), -threshold, threshold)
    w = W.partitionBy("pair").orderBy("seq")
    df = df.withColumn("signal", F.lag("position").over(w))
    gain = (F.col("y1") - F.lag("y1").over(w)) * F.col("w1") + (F.col("y2") - F.lag("y2").over(w)) * F.col("w2")
    return df.withColumn("ret", gain * F.col("signal"))
