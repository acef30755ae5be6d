"""Bars and event filters over unbounded tapes: the ordered folds with their state kept by Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..session import ship

BAR = "symbol string, bar_no long, ts timestamp, open double, high double, low double, close double, volume double, tick_num long, num_ticks long"


def dollar_bars(ticks: DataFrame, threshold: float, measure: str = "dollar") -> DataFrame:
    """B3, B4 on a stream of (symbol, seq, ts, price, size): each micro-batch's ticks by seq; the open bar is the state, of constant size."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0)
        bar, total, o, h, lo, vol, n, i = held
        rows = []
        pdf = pd.concat(list(parts)).sort_values("seq")
        for ts, price, size in zip(pdf["ts"], pdf["price"], pdf["size"], strict=True):
            if n == 0:
                o, h, lo, vol = price, price, price, 0.0
            h, lo, vol, n = max(h, price), min(lo, price), vol + size, n + 1
            total += price * size if measure == "dollar" else size if measure == "volume" else 1
            if total >= threshold:
                rows.append((key[0], bar, ts, o, h, lo, price, vol, i, n))
                bar, total, n = bar + 1, 0.0, 0
            i += 1
        state.update((int(bar), float(total), float(o), float(h), float(lo), float(vol), int(n), int(i)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BAR.split(", ")])

    ship(ticks.sparkSession)
    kept = "bar long, total double, o double, h double, l double, vol double, n long, i long"
    return ticks.groupBy("symbol").applyInPandasWithState(step, BAR, kept, "append", "NoTimeout")


def cusum_events(bars: DataFrame, h: float) -> DataFrame:
    """E3 on a stream of (symbol, seq, ts, price): the events of each micro-batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = []
        pdf = pd.concat(list(parts)).sort_values("seq")
        for seq, ts, price in zip(pdf["seq"], pdf["ts"], pdf["price"], strict=True):
            x = math.log(price)
            n += 1
            if n > 2:
                up, down = max(0.0, up + x - last), min(0.0, down + x - last)
                if down < -h:
                    down = 0.0
                    rows.append((key[0], seq, ts, price))
                elif up > h:
                    up = 0.0
                    rows.append((key[0], seq, ts, price))
            last = x
        state.update((int(n), float(last), float(up), float(down)))
        yield pd.DataFrame(rows, columns=["symbol", "seq", "ts", "price"])

    ship(bars.sparkSession)
    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, seq long, ts timestamp, price double", "n long, last double, up double, down double", "append", "NoTimeout")
