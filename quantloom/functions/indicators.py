"""Technical features over ordered bars (T1-T37). Finite windows are columns; linear recurrences are scans of affine maps over slices, and
the phase of a cycle is an ordered fold.

Bars have symbol, seq, open, high, low, close and volume. A window that is not full gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.fold import ordered_fold
from ..operators.slices import Affine, Arrays, Seen, Stage, sliced


def own() -> W:
    return W.partitionBy("symbol").orderBy("seq")


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(_col(x), n).over(own())


def over(f: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None) -> Column:
    """``f`` over the last ``n`` values, null before there are ``least`` (or ``n``) of them."""
    w = own().rowsBetween(-(n - 1), 0)
    return F.when(F.count(_col(x)).over(w) >= (n if least is None else least), f(_col(x)).over(w))


def log_return(x: str = "close", n: int = 1) -> Column:
    """T1."""
    return F.log(_col(x)) - F.log(lag(x, n))


def momentum(x: str = "close", n: int = 1) -> Column:
    """T2."""
    return _col(x) / lag(x, n) - 1


def volatility(x: str | Column, n: int, least: int | None = None) -> Column:
    """T3."""
    return over(F.stddev_samp, x, n, least)


def autocorrelation(x: str, n: int, k: int) -> Column:
    """T4: the correlation of the last n - k values with those k before them, in _lag<k>."""
    w = own().rowsBetween(-(n - 1 - k), 0)
    return F.when(F.count(F.col(f"_lag{k}")).over(w) == n - k, F.corr(_col(x), F.col(f"_lag{k}")).over(w))


def with_autocorrelation(df: DataFrame, x: str, n: int = 50, lags: tuple[int, ...] = (1, 2, 3, 4, 5), name: str = "autocorr") -> DataFrame:
    """T4 for several lags, in one window pass after one lag pass."""
    df = df.withColumns({f"_lag{k}": lag(x, k) for k in lags})
    return df.withColumns({f"{name}_{k}": autocorrelation(x, n, k) for k in lags}).drop(*(f"_lag{k}" for k in lags))


def sma(x: str | Column, n: int) -> Column:
    """T6."""
    return over(F.avg, x, n)


def wma(x: str, n: int) -> Column:
    """T7."""
    return sum((lag(x, k) * float(n - k) for k in range(1, n)), _col(x) * float(n)) / (n * (n + 1) / 2.0)


def mom(x: str, n: int) -> Column:
    """T9."""
    return _col(x) - lag(x, n)


def williams(n: int = 14) -> Column:
    """T10."""
    hi, lo = over(F.max, "high", n), over(F.min, "low", n)
    return F.try_divide(-100.0 * (hi - F.col("close")), hi - lo)


def with_stochastic(df: DataFrame, n: int = 5, k: int = 3, d: int = 3, name: str = "stoch") -> DataFrame:
    """Slow %K and %D."""
    hi, lo = over(F.max, "high", n), over(F.min, "low", n)
    df = df.withColumn("_k", F.try_divide(100.0 * (F.col("close") - lo), hi - lo))
    df = df.withColumn(f"{name}_k", over(F.avg, "_k", k))
    return df.withColumn(f"{name}_d", over(F.avg, f"{name}_k", d)).drop("_k")


def with_cci(df: DataFrame, n: int, name: str = "cci") -> DataFrame:
    """T14."""
    w = own().rowsBetween(-(n - 1), 0)
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumn("_m", over(F.avg, "_tp", n)).withColumn("_a", F.collect_list("_tp").over(w))
    mad = F.aggregate("_a", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / float(n)
    return df.withColumn(name, F.when(F.size("_a") == n, F.try_divide(F.col("_tp") - F.col("_m"), 0.015 * mad))).drop("_tp", "_m", "_a")


def ad_oscillator(k: int = 1) -> Column:
    """T15."""
    return F.try_divide(F.col("high") - lag("close", k), F.col("high") - F.col("low"))


def ffd_oscillator(n: int, high: str = "ffd_high", low: str = "ffd_low", close: str = "ffd_close") -> Column:
    """T16."""
    return F.try_divide(F.try_divide(F.col(high), lag(close, n)), F.try_divide(F.col(high), F.col(low)))


def with_obv(df: DataFrame, name: str = "obv") -> DataFrame:
    """T17, from the first volume on."""
    df = df.withColumn("_s", F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(1.0)) * F.col("volume"))
    return df.withColumn(name, F.sum("_s").over(own().rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def bands(x: str, n: int, width: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle, lower."""
    m, s = over(F.avg, x, n), over(F.stddev_pop, x, n)
    return m + width * s, m, m - width * s


def variance(x: str, n: int) -> Column:
    """T24."""
    return over(F.var_pop, x, n)


def ppo(x: str, fast: int, slow: int) -> Column:
    """T25, of simple means."""
    return F.try_divide(100.0 * (sma(x, fast) - sma(x, slow)), sma(x, slow))


def bop(n: int) -> Column:
    """T27, of smoothed prices."""
    return F.try_divide(sma("close", n) - sma("open", n), sma("high", n) - sma("low", n))


def aroon(n: int) -> Column:
    """By the latest extremes of the last n + 1 bars."""
    w = own().rowsBetween(-n, 0)
    top, bottom = F.max_by("seq_no", F.struct("high", "seq_no")).over(w), F.max_by("seq_no", F.struct(-F.col("low"), F.col("seq_no"))).over(w)
    return F.when(F.count("high").over(w) == n + 1, 100.0 * (top - bottom) / n)


def with_aroon(df: DataFrame, n: int, name: str = "aroon") -> DataFrame:
    return df.withColumn("seq_no", F.row_number().over(own())).withColumn(name, aroon(n)).drop("seq_no")


def with_ultimate(df: DataFrame, a: int = 7, b: int = 14, c: int = 28, name: str = "ultosc") -> DataFrame:
    """T29."""
    before = lag("close")
    df = df.withColumns({"_bp": F.col("close") - F.least("low", before), "_tr": F.greatest("high", before) - F.least("low", before)})
    df = df.withColumns({x: F.when(before.isNotNull(), F.col(x)) for x in ("_bp", "_tr")})
    part = lambda n: F.try_divide(over(F.sum, "_bp", n), over(F.sum, "_tr", n))
    return df.withColumn(name, 100.0 * (4 * part(a) + 2 * part(b) + part(c)) / 7.0).drop("_bp", "_tr")


def lagged_log(x: str, n: int) -> Column:
    """The log of the value n bars before; null where that is not positive."""
    return F.log(F.when(lag(x, n) > 0, lag(x, n)))


def with_volume_trend(df: DataFrame, n: int, name: str = "volume_trend") -> DataFrame:
    """1 where the mean volume of n bars rises, or else -1."""
    df = df.withColumn("_vm", sma("volume", n))
    return df.withColumn(name, F.when(F.col("_vm") > lag("_vm"), 1).otherwise(-1)).drop("_vm")


def power_trend(x: str, n: int) -> Column:
    """The last n - 1 changes, weighted by place to the power 1.5."""
    weights = [float(i) ** 1.5 for i in range(1, n)]
    return sum((lag(x, n - 1 - i) * w if i < n - 1 else _col(x) * w for i, w in enumerate(weights, 1)), F.lit(0.0)) / sum(weights)


def shifted(df: DataFrame, features: list[str], n: int = 1) -> DataFrame:
    """Every feature one bar later, against looking ahead."""
    return df.withColumns({f: lag(f, n) for f in features})


# --- recursions --------------------------------------------------------------


def _mean(n: int, rank: np.ndarray, x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """a and b of an exponential mean that starts with the mean of the first ``n`` values, by their rank; 0 is none."""
    a = np.where(rank > n, 1 - alpha, 1.0)
    return a, np.where(rank > n, alpha * x, np.where(rank > 0, x / n, 0.0))


def _from(n: int, rank: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(rank >= n, y, np.nan)


def _means(x: str, rank: str, ns: list[int], shift: int, outputs: list[str], finish=None) -> Stage:
    """A stage of exponential means (T8) of ``x``, one for each of ``ns``, over values with a rank above ``shift``."""

    def maps(c: Arrays) -> tuple[np.ndarray, np.ndarray]:
        r, v = np.maximum(c[1] - shift, 0) * ~np.isnan(c[0]), np.nan_to_num(c[0])
        made = [_mean(n, r, v, 2 / (n + 1)) for n in ns]
        return np.stack([a for a, _ in made]), np.stack([b for _, b in made])

    def done(c: Arrays, y: np.ndarray, before: np.ndarray) -> Arrays:
        r = np.maximum(c[1] - shift, 0) * ~np.isnan(c[0])
        means = [_from(n, r, v) for n, v in zip(ns, y, strict=True)]
        return means if finish is None else finish(means, [_from(n, r - 1, v) for n, v in zip(ns, before, strict=True)])

    return Stage([x, rank], ", ".join(f"{o} double" for o in outputs), Affine(len(ns), maps, done))


def _seen(inputs: list[str], tag: str) -> Stage:
    """The rank of each row among those without nulls in ``inputs``, and their last values before."""
    return Stage(inputs, ", ".join([f"_{tag}_n long", *(f"_{tag}_{k} double" for k in range(len(inputs)))]), Seen(len(inputs)))


def ema_stages(x: str, n: int, name: str) -> list[Stage]:
    """Alpha 2 / (n + 1), from the mean of the first n values on; null values are passed over."""
    return [_seen([x], name), _means(x, f"_{name}_n", [n], 0, [name])]


def macd_stages(x: str, fast: int, slow: int, signal: int, name: str) -> list[Stage]:
    """T11."""
    fast, slow, signal = (max(1, int(n)) for n in (fast, slow, signal))
    line = lambda m, _: [m[0] - m[1]]
    ranks = f"_{name}_n"
    last = _means(name, ranks, [signal], max(fast, slow) - 1, [f"{name}_signal"])
    return [_seen([x], name), _means(x, ranks, [fast, slow], 0, [name], line), last]


def gain_stages(x: str, n: int, name: str, kind: str) -> list[Stage]:
    """Wilder means of rises and falls."""

    def maps(c: Arrays) -> tuple[np.ndarray, np.ndarray]:
        rank, d = np.maximum(c[1] - 1, 0), np.nan_to_num(c[0] - c[2])
        made = [_mean(n, rank, v, 1 / n) for v in (np.maximum(d, 0.0), np.maximum(-d, 0.0))]
        return np.stack([a for a, _ in made]), np.stack([b for _, b in made])

    def finish(c: Arrays, y: np.ndarray, before: np.ndarray) -> Arrays:
        up, down = y
        both = up + down
        out = np.where(both == 0, 0.0, 100 * (up if kind == "rsi" else up - down) / both)
        return [_from(n, c[1] - 1, out)]

    return [_seen([x], name), Stage([x, f"_{name}_n", f"_{name}_0"], f"{name} double", Affine(2, maps, finish))]


def trix_stages(x: str, n: int, name: str) -> list[Stage]:
    """The growth of a mean of a mean of a mean."""
    rank = f"_{name}_n"
    grown = lambda m, before: [np.where(np.isnan(before[0]) | (before[0] == 0), np.nan, 100 * (m[0] / before[0] - 1))]
    return [_seen([x], name), _means(x, rank, [n], 0, [f"_{name}_a"]), _means(f"_{name}_a", rank, [n], n - 1, [f"_{name}_b"]), _means(f"_{name}_b", rank, [n], 2 * (n - 1), [name], grown)]


def directional_stages(n: int, tag: str) -> list[Stage]:
    """Atr, minus_di, dx and adx; bars with a null are passed over."""
    seen = f"dm{tag}"

    def moves(c: Arrays) -> tuple[np.ndarray, Arrays]:
        """The number of the change, and true range, rise and fall."""
        h, lo, _, rank, h0, lo0, c0 = c
        number = np.maximum(rank - 1, 0)
        up, down = h - h0, lo0 - lo
        tr = np.maximum(h - lo, np.maximum(np.abs(h - c0), np.abs(lo - c0)))
        return number, [np.where(number > 0, v, 0.0) for v in (tr, np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0))]

    def maps(c: Arrays) -> tuple[np.ndarray, np.ndarray]:
        number, sums = moves(c)
        mean = _mean(n, number, sums[0], 1 / n)
        a = np.where(number >= n, 1 - 1 / n, 1.0)
        return np.stack([mean[0], a, a, a]), np.stack([mean[1], *sums])

    def finish(c: Arrays, y: np.ndarray, before: np.ndarray) -> Arrays:
        number = np.maximum(c[3] - 1, 0)
        atr, tr, up, down = y
        p, m = np.where(tr == 0, 0.0, 100 * up / tr), np.where(tr == 0, 0.0, 100 * down / tr)
        dx = np.where(p + m == 0, 0.0, 100 * np.abs(p - m) / (p + m))
        return [_from(n, number, v) for v in (atr, m, dx)]

    def adx_maps(c: Arrays) -> tuple[np.ndarray, np.ndarray]:
        a, b = _mean(n, np.maximum(c[1] - n, 0), np.nan_to_num(c[0]), 1 / n)
        return a[None], b[None]

    bars = ["high", "low", "close"]
    first = Stage([*bars, f"_{seen}_n", *(f"_{seen}_{k}" for k in range(3))], f"atr{tag} double, minus_di{tag} double, dx{tag} double", Affine(4, maps, finish))
    adx = Stage([f"dx{tag}", f"_{seen}_n"], f"adx{tag} double", Affine(1, adx_maps, lambda c, y, _: [_from(n, c[1] - n, y[0])]))
    return [_seen(bars, seen), first, adx]


def recurrences(df: DataFrame, *specs: list[Stage], by: str = "symbol") -> DataFrame:
    """``df`` with what several chains of stages give, side by side: one shuffle, and one scan for the first stages of all, one for the second ones."""
    names = {x.split()[0] for stages in specs for s in stages for x in s.outputs.split(", ")}
    wanted = {x.split()[0] for stages in specs for s in stages[1:] for x in s.outputs.split(", ") if not x.startswith(f"_{stages[-1].outputs.split()[0]}")}
    return sliced(df, [by], ["seq"]).scans(list(specs)).rows(*(names - wanted))


def with_ema(df: DataFrame, x: str, n: int, name: str = "ema") -> DataFrame:
    """T8."""
    return recurrences(df, ema_stages(x, n, name))


def with_macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd") -> DataFrame:
    """T11."""
    out = recurrences(df, macd_stages(x, fast, slow, signal, name))
    return out.withColumn(f"{name}_hist", F.col(name) - F.col(f"{name}_signal"))


def with_rsi(df: DataFrame, n: int = 14, x: str = "close", name: str = "rsi") -> DataFrame:
    """T13."""
    return recurrences(df, gain_stages(x, n, name, "rsi"))


def with_cmo(df: DataFrame, n: int = 14, x: str = "close", name: str = "cmo") -> DataFrame:
    """T26."""
    return recurrences(df, gain_stages(x, n, name, "cmo"))


def with_trix(df: DataFrame, n: int, x: str = "close", name: str = "trix") -> DataFrame:
    """T18."""
    return recurrences(df, trix_stages(x, n, name))


def with_directional(df: DataFrame, n: int = 14, tag: str = "") -> DataFrame:
    """Atr, minus_di, dx and adx, in one pass."""
    return recurrences(df, directional_stages(n, tag))


def with_hilbert_sine(df: DataFrame, x: str = "close") -> DataFrame:
    """Sine and lead sine of the dominant cycle's phase, after Ehlers' homodyne discriminator."""
    import math

    def start():
        price: list[float] = []
        smooth, det, q1, i1 = [0.0] * 7, [0.0] * 7, [0.0] * 7, [0.0] * 7
        i2 = q2 = re = im = period = smooth_period = 0.0
        history: list[float] = []

        def push(a, v):
            a.insert(0, v)
            a.pop()

        def hilbert(a, scale):
            return (0.0962 * a[0] + 0.5769 * a[2] - 0.5769 * a[4] - 0.0962 * a[6]) * scale

        def step(v):
            nonlocal i2, q2, re, im, period, smooth_period
            if v is None:
                return None, None
            price.append(v)
            del price[:-4]
            if len(price) < 4:
                return None, None
            push(smooth, (4 * price[3] + 3 * price[2] + 2 * price[1] + price[0]) / 10)
            history.append(smooth[0])
            del history[:-64]
            scale = 0.075 * period + 0.54
            push(det, hilbert(smooth, scale))
            push(q1, hilbert(det, scale))
            push(i1, det[3])
            ji, jq = hilbert(i1, scale), hilbert(q1, scale)
            a, b = 0.2 * (i1[0] - jq) + 0.8 * i2, 0.2 * (q1[0] + ji) + 0.8 * q2
            re, im = 0.2 * (a * i2 + b * q2) + 0.8 * re, 0.2 * (a * q2 - b * i2) + 0.8 * im
            i2, q2 = a, b
            last = period
            if im and re:
                period = 2 * math.pi / math.atan(im / re)
            period = min(max(min(max(period, 0.67 * last), 1.5 * last) if last else period, 6.0), 50.0)
            period = 0.2 * period + 0.8 * last
            smooth_period = 0.33 * period + 0.67 * smooth_period
            n = int(smooth_period + 0.5)
            if len(history) < 63:
                return None, None
            rp = sum(math.sin(2 * math.pi * k / n) * history[-1 - k] for k in range(n)) if n else 0.0
            ip = sum(math.cos(2 * math.pi * k / n) * history[-1 - k] for k in range(n)) if n else 0.0
            phase = math.degrees(math.atan(rp / ip)) if abs(ip) > 1e-3 else 90.0 * (1 if rp > 0 else -1)
            phase += 90 + 360 / smooth_period if smooth_period else 90
            phase += 180 if ip < 0 else 0
            phase -= 360 if phase > 315 else 0
            return math.sin(math.radians(phase)), math.sin(math.radians(phase + 45))

        return step

    return ordered_fold(df, ["symbol"], ["seq"], [x], "sine double, lead_sine double", start)


# --- trend layer (T35) -------------------------------------------------------


def rises(x: str) -> Column:
    return F.when(F.col(x) > lag(x), 1).otherwise(-1)


def positive(x: str) -> Column:
    return F.when(F.col(x) > 0, 1).otherwise(-1)


def below_close(x: str) -> Column:
    return F.when(F.col(x) < F.col("close"), 1).otherwise(-1)


def rsi_trend(x: str, contrary: bool = True) -> Column:
    """Over 70, 30-70 rising, 30-70 falling, under 30: -1, 1, -1, 1; or 1, 1, -1, -1 if not ``contrary``."""
    a, b = (-1, 1) if contrary else (1, -1)
    r = F.col(x)
    mid = (r >= 30) & (r <= 70)
    return F.when(r > 70, a).when(mid & (r > lag(x)), 1).when(mid & (r < lag(x)), -1).when(r < 30, b).otherwise(0)


def cci_trend(x: str) -> Column:
    return F.when(F.col(x) > 200, -1).when(F.col(x) < -200, 1).when(F.col(x) > lag(x), 1).otherwise(-1)


def cmo_trend(x: str) -> Column:
    return F.when(F.col(x) > 45, -1).when(F.col(x) < -45, 1).otherwise(0)


def macd_signal_trend(line: str, signal: str) -> Column:
    a, b = F.col(line), F.col(signal)
    return F.when((a > b) & (a < 0), 1).when((a < b) & (a > 0), -1).otherwise(0)


def split_by_place(df: DataFrame, head: float = 0.7) -> DataFrame:
    """Part is train for the first floor((n - 1) * head) rows of a symbol, test for the last floor((n - 1) * (1 - head))."""
    n = F.count("*").over(W.partitionBy("symbol"))
    k = F.row_number().over(own())
    part = F.when(k <= F.floor((n - 1) * head), "train").when(k > n - F.floor((n - 1) * (1 - head)), "test")
    return df.withColumn("part", part)


def aligned(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows of both, without any null."""
    return left.join(right, on, how).na.drop("any")
