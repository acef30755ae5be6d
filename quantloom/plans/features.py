"""Feature sets (FS1-FS11): compositions of the indicators, lagged against looking ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as T
from ..operators import fracdiff

PERIODS = (5, 10, 25, 50)


def continuous(bars: DataFrame, periods: tuple[int, ...] = PERIODS, lagged: bool = True) -> tuple[DataFrame, list[str]]:
    """FS6, FS8: ten oscillators for each period."""
    df, names = bars, []
    specs = [T.macd_stages("close", max(1, p // 2), p, max(1, p // 3), f"macd_{p}") for p in periods] + [T.gain_stages("close", p, f"rsi_{p}", "rsi") for p in periods]
    df = T.recurrences(df, *specs)
    for p in periods:
        df = df.withColumn(f"macd_{p}_hist", F.col(f"macd_{p}") - F.col(f"macd_{p}_signal"))
        cols = {f"sma_{p}": T.sma("close", p), f"wma_{p}": T.wma("close", p), f"mom_{p}": T.mom("close", p), f"willr_{p}": T.williams(p), f"ad_{p}": T.ad_oscillator(p if len(periods) > 1 else 1)}
        df = df.withColumns(cols)
        df = T.with_stochastic(df, p, max(1, p // 2), max(1, p // 2), f"stoch_{p}")
        df = T.with_cci(df, p, f"cci_{p}")
        names += [*cols, f"stoch_{p}_k", f"stoch_{p}_d", f"cci_{p}", f"macd_{p}", f"macd_{p}_signal", f"macd_{p}_hist", f"rsi_{p}"]
    return (T.shifted(df, names) if lagged else df), names


def trend_layer(bars: DataFrame, periods: tuple[int, ...] = PERIODS) -> tuple[DataFrame, list[str]]:
    """FS7, FS9: the oscillators as trends of -1, 0 and 1. Over several periods the terms compare lagged indicators and are lagged again."""
    df, _ = continuous(bars, periods, lagged=len(periods) > 1)
    trends = {}
    for p in periods:
        trends |= {
            f"t_sma_{p}": T.below_close(f"sma_{p}"), f"t_wma_{p}": T.below_close(f"wma_{p}"), f"t_mom_{p}": T.positive(f"mom_{p}"),
            f"t_willr_{p}": T.rises(f"willr_{p}"), f"t_ad_{p}": T.rises(f"ad_{p}"), f"t_stoch_k_{p}": T.rises(f"stoch_{p}_k"),
            f"t_stoch_d_{p}": F.when(F.col(f"stoch_{p}_k") > T.lag(f"stoch_{p}_d"), 1).otherwise(-1), f"t_macd_{p}": T.rises(f"macd_{p}"),
            f"t_rsi_{p}": T.rsi_trend(f"rsi_{p}", contrary=len(periods) > 1),
        }
        if len(periods) == 1:
            trends[f"t_cci_{p}"] = T.cci_trend(f"cci_{p}")
    df = df.withColumns(trends)
    return T.shifted(df, list(trends)), list(trends)


def volumes(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """FS1: the volume, its balance and its mean of 20."""
    names = ["volume", "obv", "volume_ewa_20"]
    return T.shifted(T.recurrences(T.with_obv(bars), T.ema_stages("volume", 20, "volume_ewa_20")), names), names


def _returns_of(df: DataFrame, log_ret: Column, windows: tuple[int, ...] = (50, 31, 15)) -> tuple[DataFrame, list[str]]:
    """The returns ``log_ret``, momentum of 1 to 5 bars, volatility, autocorrelation and lags, none of them lagged."""
    df = df.withColumn("log_ret", log_ret)
    cols = {f"mom{k}": T.momentum("close", k) for k in range(1, 6)} | {f"volatility_{n}": T.volatility("log_ret", n) for n in windows} | {f"log_t{k}": T.lag("log_ret", k) for k in range(1, 6)}
    return T.with_autocorrelation(df.withColumns(cols), "log_ret", 50), ["log_ret", *cols, *(f"autocorr_{k}" for k in range(1, 6))]


def combined(bars: DataFrame, periods: tuple[int, ...] = (5, 12, 25)) -> tuple[DataFrame, list[str]]:
    """FS2: the lagged oscillators of several periods (FS8) and the terms of returns, all one bar later."""
    df, oscillators = continuous(bars, periods)
    df, names = _returns_of(df, T.log_return())
    return T.shifted(df, [*oscillators, *names]), [*oscillators, *names]


def differenced(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """FS3: the terms of returns, with the log of the least differenced close for the return; null where that is not positive."""
    df = fracdiff.with_least_ffd(bars, "close", out="_ffd")
    df, names = _returns_of(df, F.log(F.when(F.col("_ffd") > 0, F.col("_ffd"))))
    return T.shifted(df.drop("_ffd"), names), names


def trends(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """FS4: the return, long momentum and volatility, three autocorrelations, TRIX, RSI, ADX, stochastic, and means of returns and volumes."""
    cols = {"log_ret": T.log_return(), "mom5": T.momentum("close", 50)}
    df = bars.withColumns(cols)
    spread = {f"volatility_{n}": T.volatility("log_ret", n, 50) for n in (50, 100, 250)}
    df = T.with_obv(T.with_stochastic(T.with_autocorrelation(df.withColumns(spread), "log_ret", 50, (1, 3, 5))))
    trix, volume = [T.trix_stages("close", n, f"trix_{n}") for n in (5, 12, 26)], {"volume_ewa_20": 20, "volume_ewa_500": 50, "volume_ewa_100": 100}
    specs = [*trix, T.gain_stages("close", 50, "rsi_50", "rsi"), T.directional_stages(50, "_50"), T.ema_stages("log_ret", 20, "return_ewa_50")]
    df = T.recurrences(df, *specs, *(T.ema_stages("volume", n, name) for name, n in volume.items()))
    names = [*cols, *spread, "trix_5", "trix_12", "trix_26", "autocorr_1", "autocorr_3", "autocorr_5", "rsi_50", "adx_50", "return_ewa_50", "stoch_k", "stoch_d", "obv", *volume]
    return T.shifted(df, names), names


def returns(bars: DataFrame, windows: tuple[int, ...] = (50, 31, 15)) -> tuple[DataFrame, list[str]]:
    """What FS1 to FS4 have in common, in one set: log returns, momentum, volatility, autocorrelation, lags and trend-following terms."""
    df = bars.withColumn("log_ret", T.log_return())
    cols = {f"mom_{k}": T.momentum("close", k) for k in range(1, 6)} | {f"vol_{n}": T.volatility("log_ret", n) for n in windows} | {f"lag_{k}": T.lag("log_ret", k) for k in range(1, 6)}
    df = T.with_autocorrelation(df.withColumns(cols), "log_ret", 50)
    df = T.with_obv(df)
    trix, ema = [T.trix_stages("close", n, f"trix_{n}") for n in (5, 12, 26)], [T.ema_stages("close", n, f"ema_{n}") for n in (20, 50, 100)]
    df = T.recurrences(df, *trix, *ema, T.gain_stages("close", 50, "rsi_50", "rsi"), T.directional_stages(50, "_50"))
    df = T.with_stochastic(df)
    names = ["log_ret", *cols, *(f"autocorr_{k}" for k in range(1, 6)), "obv", "trix_5", "trix_12", "trix_26", "ema_20", "ema_50", "ema_100", "rsi_50", "adx_50", "stoch_k", "stoch_d"]
    return T.shifted(df, names), names


def custom(bars: DataFrame, periods: tuple[int, ...] = (10, 20), d: float = 0.4, least: float = 0.01) -> tuple[DataFrame, list[str]]:
    """FS5: trends of RSI, TRIX, Aroon and bands, momentum, variance, PPO, DX and CMO, and lagged logs of the differenced prices.

    Prices are differenced by ``d`` where bars have no ffd_open, ffd_high, ffd_low and ffd_close; features are not lagged again.
    """
    df = bars
    for x in ("open", "high", "low", "close"):
        if f"ffd_{x}" not in df.columns:
            df = fracdiff.with_ffd(df, x, d, least, f"ffd_{x}")
    specs = [x for p in periods for x in (T.trix_stages("close", p, f"trix_{p}"), T.gain_stages("close", p, f"cmo_{p}", "cmo"), T.directional_stages(p, f"_{p}"))]
    df = T.recurrences(df, T.gain_stages("close", 10, "rsi_10", "rsi"), *specs).withColumn("ad_osc", T.ad_oscillator(1))
    cols = {"rsi_10_trend": T.rsi_trend("rsi_10", contrary=False), "ad_osc_trend": T.rises("ad_osc")}
    for p in periods:
        half = max(1, p // 2)
        df = T.with_aroon(df, p, f"aroon_{p}")
        upper, _, lower = T.bands("ffd_close", p)
        cols |= {
            f"trix_{p}_trend": T.positive(f"trix_{p}"), f"bband_diff_{p}": upper - lower, f"bband_upper_{p}_trend": F.when(F.col("ffd_close") > upper, 1).otherwise(0),
            f"bband_lower_{p}_trend": F.when(F.col("ffd_close") < lower, -1).otherwise(0), f"aroon_{p}_trend": T.positive(f"aroon_{p}"), f"mom_{p}": T.mom("close", p),
            f"var_ffd_{p}": T.variance("ffd_close", p), f"ppo_{p}": T.ppo("close", half, p), **{f"log_ffd_{x}_{p}": T.lagged_log(f"ffd_{x}", half) for x in ("open", "high", "low", "close")},
        }
    names = [*cols, *(f"{x}_{p}" for p in periods for x in ("trix", "cmo", "dx"))]
    return df.withColumns(cols), names


def everything(bars: DataFrame, period: int = 14) -> tuple[DataFrame, list[str]]:
    """FS10: one period of every indicator."""
    p, half = period, max(1, period // 2)
    df = bars.withColumn("log_ret", T.log_return())
    upper, _, lower = T.bands("close", p)
    cols = {
        "vol_100": T.volatility("log_ret", 100, 50), "vol_250": T.volatility("log_ret", 250, 50), "bb_upper": upper, "bb_lower": lower, "sma": T.sma("close", p),
        "wma": T.wma("close", p), "willr": T.williams(p), "ad": T.ad_oscillator(p), "mom": T.mom("close", p), "var": T.variance("close", p),
        "ppo": T.ppo("close", half, p), "bop": T.bop(p), "power_trend": T.power_trend("log_ret", p),
    }
    df = df.withColumns(cols)
    df = T.with_stochastic(T.with_cci(T.with_aroon(T.with_ultimate(df, max(1, p // 3), half, p), p), p), p, half, half)
    gains = [T.gain_stages("close", p, "rsi", "rsi"), T.gain_stages("close", p, "cmo", "cmo")]
    df = T.recurrences(df, T.ema_stages("close", p, "ema"), T.macd_stages("close", half, p, max(1, half * 3 // 4), "macd"), T.trix_stages("close", p, "trix"), T.directional_stages(p, ""), *gains)
    df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    df = T.with_hilbert_sine(df)
    names = [*cols, "ultosc", "aroon", "cci", "stoch_k", "stoch_d", "ema", "macd", "macd_signal", "macd_hist", "rsi", "trix", "cmo", "atr", "minus_di", "dx", "adx", "sine", "lead_sine"]
    return T.shifted(df, names), names


def everything_trends(bars: DataFrame, period: int = 14) -> tuple[DataFrame, list[str]]:
    """FS11: the trends of FS10, not lagged again."""
    df, _ = everything(bars, period)
    trends = {
        "t_sma": T.below_close("sma"), "t_wma": T.below_close("wma"), "t_ema": T.below_close("ema"), "t_mom": T.positive("mom"), "t_ppo": T.positive("ppo"),
        "t_trix": T.positive("trix"), "t_aroon": T.positive("aroon"), "t_bop": T.positive("bop"), "t_willr": T.rises("willr"), "t_macd": T.rises("macd"), "t_ad": T.rises("ad"),
        "t_stoch_k": T.rises("stoch_k"), "t_stoch_d": F.when(F.col("stoch_k") > T.lag("stoch_d"), 1).otherwise(-1), "t_macd_signal": T.macd_signal_trend("macd", "macd_signal"),
        "t_rsi": T.rsi_trend("rsi", contrary=False), "t_cci": F.when(F.col("cci") > 200, -1).when(F.col("cci") < -200, 1).otherwise(0), "t_cmo": T.cmo_trend("cmo"),
        "t_bb_upper": F.when(F.col("bb_upper") < F.col("close"), 1).otherwise(0), "t_bb_lower": F.when(F.col("bb_lower") > F.col("close"), -1).otherwise(0),
    }
    return df.withColumns(trends), list(trends)
