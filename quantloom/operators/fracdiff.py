"""Fractional differencing and unit-root tests (FD1-FD18)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .slices import Seen, Slices, Stage, Sums, sliced

STEPS = tuple(k / 10 for k in range(11))


def expanding_weights(d: float, size: int) -> list[float]:
    """FD1: w_0 = 1, w_k = -w_(k-1) (d - k + 1) / k, newest first."""
    w = [1.0]
    for k in range(1, size):
        w.append(-w[-1] * (d - k + 1) / k)
    return w


def ffd_weights(d: float, least: float = 1e-5) -> list[float]:
    """FD2: the weights up to the first that is below ``least`` in size, newest first."""
    w, k = [1.0], 1
    while abs(x := -w[-1] * (d - k + 1) / k) >= least:
        w.append(x)
        k += 1
    return w


def _own() -> W:
    return W.partitionBy("symbol").orderBy("seq")


def with_ffd(df: DataFrame, value: str, d: float, least: float = 1e-5, out: str = "ffd") -> DataFrame:
    """FD4, FD12, FD16 over a column with gaps: rows before the first full window, and rows without a value, get null."""
    filled = F.last(value, ignorenulls=True).over(_own().rowsBetween(W.unboundedPreceding, 0))
    w = ffd_weights(d, least)
    df = df.withColumn("_x", filled)
    if len(w) <= 64:
        dot = F.lit(0.0)
        for k, x in enumerate(w):
            dot = dot + F.lag("_x", k).over(_own()) * F.lit(x) if k else dot + F.col("_x") * F.lit(x)
    else:
        past = F.collect_list("_x").over(_own().rowsBetween(-(len(w) - 1), 0))
        total = F.aggregate(F.zip_with(F.reverse(past), F.array(*(F.lit(x) for x in w)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        dot = F.when(F.size(past) == len(w), total)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), dot)).drop("_x")


def expanding_array(d: float, size: int) -> np.ndarray:
    """``expanding_weights`` as an array."""
    k = np.arange(1, size, dtype=np.float64)
    return np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)]) if size else np.zeros(0)


#: Values of a block of the convolution at least, and blocks of a symbol at most.
BLOCK, BLOCKS = 1 << 16, 64


def _convolved(d: float, least: float):
    """Rows (symbol, to, block, size, n, x) by (symbol, to), sorted by block: (symbol, p, fd) of the block ``to``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, spectra = None, None, {}

        def told() -> pa.RecordBatch:
            symbol, to, size, n, count = now
            y = np.fft.irfft(held, 2 * size)[size : size + count]
            w = np.abs(expanding_array(d, n))
            # a value whose weights lost are over the bound is skipped
            skip = int((1 - (np.cumsum(w) - w) / w.sum() > least).sum())
            p = to * size + np.arange(count)
            return pa.RecordBatch.from_arrays([pa.array([symbol] * count, pa.string()), pa.array(p), pa.array(np.where(p + 1 > skip, y, np.nan), from_pandas=True)], ["symbol", "p", "fd"])

        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1)
                symbol, to, block, size, n = (r.column(c)[0].as_py() for c in ("symbol", "to", "block", "size", "n"))
                x = r.column("x").flatten().to_numpy(zero_copy_only=False)
                if now is None or now[:2] != (symbol, to):
                    if now is not None:
                        yield told()
                    if now is None or (now[2], now[3]) != (size, n):
                        spectra = {}
                    now, held = (symbol, to, size, n, 0), np.zeros(size + 1, dtype=complex)
                lag = to - block
                if lag not in spectra:
                    w = expanding_array(d, min(n, (lag + 1) * size))
                    part = np.zeros(2 * size)
                    a = max(0, (lag - 1) * size)
                    part[a - (lag - 1) * size : len(w) - (lag - 1) * size] = w[a:]
                    spectra = {lag: np.fft.rfft(part)}
                held = held + np.fft.rfft(x, 2 * size) * spectra[lag]
                if lag == 0:
                    now = (*now[:4], len(x))
        if now is not None:
            yield told()

    return run


def expanding(df: DataFrame, value: str, d: float, least: float = 0.01, out: str = "fd") -> DataFrame:
    """FD3: all past values, skipping rows before the weights that are lost fall under ``least``; gaps count as the value before them, and get null.

    The sum over all past values is a convolution. A symbol's values are cut into blocks, BLOCKS at most; a block of results is the sum
    over the blocks before it of products of their spectra, so a task holds one block, and the work is near n log n.
    """
    n = df.groupBy("symbol").agg(F.count("*").alias("_n"))
    s = sliced(df, ["symbol"], ["seq"]).scan([Stage([value], "_rank long, _last double", Seen(1))])
    s = Slices(s.df.withColumn("_f", F.coalesce(F.col(value).cast("double"), "_last")).withColumn("_one", F.col("_f").isNotNull().cast("long")), ["symbol"])
    rows = cut(s.scan([Stage(["_one"], "_p long", Sums(1, np.int64))]).df.withColumn("_p", F.col("_p") - 1))
    size = F.greatest(F.lit(BLOCK), F.ceil(F.col("_n") / BLOCKS)).cast("long")
    x = rows.filter("_one = 1").select("symbol", "_p", "_f").join(n.withColumn("_size", size), "symbol")
    blocks = x.groupBy("symbol", "_size", "_n", F.expr("_p div _size").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_f"))), lambda v: v["_f"]).alias("x"))
    last = blocks.groupBy("symbol").agg(F.max("block").alias("_end"))
    sent = blocks.join(last, "symbol").select("symbol", F.explode(F.sequence("block", "_end")).alias("to"), "block", F.col("_size").alias("size"), F.col("_n").alias("n"), "x")
    sent = sent.repartition("symbol", "to").sortWithinPartitions("symbol", "to", "block")
    made = sent.mapInArrow(_convolved(d, least), "symbol string, p long, fd double")
    made = made.select(F.col("symbol"), F.col("p").alias("_p"), F.col("fd").alias("_y"))
    found = rows.join(made, ["symbol", "_p"], "left")
    return found.withColumn(out, F.when(F.col(value).isNotNull(), F.col("_y"))).drop("_rank", "_last", "_f", "_one", "_p", "_y")


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_p_value(stat: float | None) -> float | None:
    """MacKinnon's response surface for one series with a constant. The published coefficients."""
    if stat is None:
        return None
    if stat > 2.74:
        return 1.0
    if stat < -18.83:
        return 0.0
    small = (2.1659, 1.4412, 0.038269)
    large = (1.7339, 0.93202, -0.12745, -0.010368)
    c = small if stat <= -1.61 else large
    return _phi(sum(x * stat**k for k, x in enumerate(c)))


def adf_critical(n: Column) -> Column:
    """The 5 % value for n observations. The published polynomial."""
    return F.lit(-2.86154) - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n)


def adf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """FD5: (by, adf_stat, p_value, lags, n_obs, crit_5): the unit-root test with a constant and one lag, by moments in one aggregate.

    The 3x3 regression is solved in columns; a singular one gives null.
    """
    own = W.partitionBy(*by).orderBy("seq")
    x = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    x = x.withColumn("_m", F.avg(value).over(W.partitionBy(*by))).withColumn("_c", F.col(value) - F.col("_m"))
    x = x.withColumn("_y", F.lag("_c").over(own)).withColumn("_z", F.col("_c") - F.col("_y")).withColumn("_d", F.lag("_z").over(own)).filter("_d is not null")
    sums = {"y": "_y", "d": "_d", "z": "_z", "yy": "_y*_y", "yd": "_y*_d", "dd": "_d*_d", "zz": "_z*_z", "yz": "_y*_z", "dz": "_d*_z"}
    m = x.groupBy(*by).agg(F.count("*").alias("n_obs"), *(F.sum(F.expr(e)).alias(f"s_{k}") for k, e in sums.items()))
    c = {k: f"(s_{k} - s_{k[0]} * s_{k[1]} / n_obs)" for k in ("yy", "yd", "dd", "zz", "yz", "dz")}  # centred: the constant is solved away
    det = f"({c['yy']} * {c['dd']} - {c['yd']} * {c['yd']})"
    rho = f"try_divide({c['yz']} * {c['dd']} - {c['dz']} * {c['yd']}, {det})"
    phi = f"try_divide({c['dz']} * {c['yy']} - {c['yz']} * {c['yd']}, {det})"
    rss = f"({c['zz']} - {rho} * {c['yz']} - {phi} * {c['dz']})"
    stat = f"try_divide({rho}, sqrt(try_divide({rss}, n_obs - 3) * try_divide({c['dd']}, {det})))"
    # a filter on the result must not be pushed below, where it would repeat these expressions within each other
    m = m.withColumn("adf_stat", F.when(F.monotonically_increasing_id() >= 0, F.nanvl(F.expr(stat), F.lit(None).cast("double"))))
    return m.select(*by, "adf_stat", p_value(F.col("adf_stat")).alias("p_value"), F.lit(1).alias("lags"), "n_obs", adf_critical(F.col("n_obs").cast("double")).alias("crit_5"))


def p_value(stat: Column) -> Column:
    """``adf_p_value`` as a column, with the normal distribution's rational approximation."""
    from ..functions.scalar import normal_cdf

    s = F.lit(2.1659) + 1.4412 * stat + 0.038269 * stat * stat
    g = F.lit(1.7339) + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat
    return F.when(stat.isNull(), F.lit(None).cast("double")).when(stat > 2.74, 1.0).when(stat < -18.83, 0.0).when(stat <= -1.61, normal_cdf(s)).otherwise(normal_cdf(g))


def long_form(df: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, seq, feature, x)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features)))
    return df.select("symbol", "seq", pairs.alias("p")).select("symbol", "seq", "p.feature", "p.x")


def sweep(df: DataFrame, value: str, least: float = 0.01, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """FD6-FD8: (symbol, d, adf_stat, p_value, lags, n_obs, crit_5, corr) for each d, in one pass over the series."""
    names = []
    for k, d in enumerate(steps):
        df = with_ffd(df, value, d, least, f"_d{k}")
        names.append(f"_d{k}")
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(n).alias("x")) for d, n in zip(steps, names, strict=True))))
    long = df.select("symbol", "seq", F.col(value).alias("_v"), pairs.alias("p")).select("symbol", "seq", "_v", "p.d", "p.x")
    corr = long.filter("x is not null").groupBy("symbol", "d").agg(F.corr("_v", "x").alias("corr"))
    return adf(long, "x", ["symbol", "d"]).join(corr, ["symbol", "d"])


def adf_table(df: DataFrame, features: list[str]) -> DataFrame:
    """FD13."""
    return adf(long_form(df, features), "x", ["symbol", "feature"])


def non_stationary(df: DataFrame, features: list[str], level: float = 0.05) -> DataFrame:
    """FD14."""
    return adf_table(df, features).filter(F.col("p_value") >= level).select("symbol", "feature")


def least_d(df: DataFrame, features: list[str], least: float = 0.01, level: float = 0.05, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """FD9-FD11, FD15: (symbol, feature, d): the first d of ``steps`` at which the feature is stationary; null if there is none."""
    out = None
    for f in features:
        s = sweep(df.select("symbol", "seq", F.col(f).cast("double").alias(f)), f, least, steps)
        d = s.groupBy("symbol").agg(F.min(F.when(F.col("p_value") < level, F.col("d"))).alias("d")).select("symbol", F.lit(f).alias("feature"), "d")
        out = d if out is None else out.union(d)
    return out


def with_least_ffd(df: DataFrame, value: str, least: float = 0.01, level: float = 0.05, steps: tuple[float, ...] = STEPS, out: str = "ffd") -> DataFrame:
    """FD9: ``value`` differenced by its symbol's least d, or the greatest of ``steps`` if none makes it stationary. The chosen ones stay in the plan."""
    chosen = least_d(df, [value], least, level, steps).select("symbol", F.coalesce("d", F.lit(float(steps[-1]))).alias("_least"))
    for k, d in enumerate(steps):
        df = with_ffd(df, value, d, least, f"_d{k}")
    df = df.join(chosen, "symbol").withColumn(out, F.coalesce(*(F.when(F.col("_least") == float(d), F.col(f"_d{k}")) for k, d in enumerate(steps))))
    return df.drop("_least", *(f"_d{k}" for k in range(len(steps))))


def apply_d(df: DataFrame, chosen: dict[str, float], least: float = 0.01) -> DataFrame:
    """FD12, FD16: each feature of ``chosen`` differenced by its d, in place."""
    for f, d in chosen.items():
        df = with_ffd(df, f, d, least, f)
    return df


def stationary_features(df: DataFrame, features: list[str], least: float = 0.01, level: float = 0.05) -> DataFrame:
    """FD18: running sums of ``features``, the non-stationary ones differenced by their least d (of the symbol with the greatest)."""
    for f in features:
        df = df.withColumn(f, F.sum(f).over(_own().rowsBetween(W.unboundedPreceding, 0)))
    found = least_d(df, features, least, level).groupBy("feature").agg(F.max("d").alias("d")).collect()
    return apply_d(df, {r.feature: r.d for r in found if r.d}, least)


def weight_curves(spark, steps: tuple[float, ...] = STEPS, size: int = 50) -> DataFrame:
    """FD17: the data of the weight plot."""
    return spark.createDataFrame([(float(d), k, float(w)) for d in steps for k, w in enumerate(expanding_weights(d, size))], "d double, k int, w double")
