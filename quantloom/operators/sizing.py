"""Active signals (Z3) and the sized signal of a model's probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import discrete, signal


def active_signals(signals: DataFrame) -> DataFrame:
    """Z3: (symbol, t, signal): at each start or end the mean of the signals (symbol, t0, t1, signal) with t0 <= t < t1; open ones have a null t1.

    A sweep with running sums: no signal meets another.
    """
    turns = signals.select("symbol", F.col("t0").alias("t"), F.col("signal").alias("s"), F.lit(1).alias("n")).union(
        signals.filter("t1 is not null").select("symbol", F.col("t1").alias("t"), -F.col("signal"), F.lit(-1))
    )
    at = turns.groupBy("symbol", "t").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    w = W.partitionBy("symbol").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    run = at.select("symbol", "t", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
    return run.select("symbol", "t", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("signal"))


def sized(events: DataFrame, classes: int = 2, step: float = 0.05, side: str | None = None) -> DataFrame:
    """Events (symbol, t0, t1, prob, pred) as averaged, discrete signals."""
    raw = events.withColumn("signal", signal(F.col("prob"), F.col("pred"), classes, None if side is None else F.col(side)))
    return active_signals(raw).withColumn("signal", discrete(F.col("signal"), step))
