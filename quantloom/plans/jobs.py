"""Example jobs (S10, S11): tapes of CSV files to dollar bars on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators import bars
from ..sources import tape

#: Turnover of a bar: of one liquid fund, and of country funds. The defaults of the jobs.
ONE, MANY = 7e9, 15e6


def one_fund(spark: SparkSession, path: str, out: str, symbol: str = "SPY", threshold: float = ONE) -> None:
    """The dollar bars of one instrument's trades, appended to ``out``."""
    tape.write_bars(bars.dollar_bars(tape.read_trades(spark, path, symbol), threshold), out)


def many_funds(spark: SparkSession, paths: dict[str, str], out: str, threshold: float = MANY) -> None:
    """The dollar bars of several instruments' trades, one job for all; ``paths`` has each symbol's files."""
    ticks = [tape.read_trades(spark, path, symbol) for symbol, path in sorted(paths.items())]
    if ticks:
        tape.write_bars(bars.dollar_bars(reduce(DataFrame.union, ticks), threshold), out)
