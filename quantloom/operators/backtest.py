"""Paths, returns and performance (K5-K11), and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .bars import business_day
from .slices import Stage, Sums, sliced


def assemble_paths(predictions: DataFrame, paths: DataFrame) -> DataFrame:
    """K5: predictions (symbol, t, group, split, signal) as (symbol, t, path, signal)."""
    return predictions.join(paths, ["group", "split"]).select("symbol", "t", "path", "signal")


def path_returns(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """K6."""
    return paths.join(labels, ["symbol", "t"]).withColumn("ret", F.col("signal") * F.col("label_ret"))


def daily_returns(returns: DataFrame) -> DataFrame:
    """K7: (symbol, day, ret) over business days from compounded returns (symbol, seq, ts, ret); the first day is lost, gaps give 0."""
    w = W.partitionBy("symbol").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    value = returns.withColumn("_v", F.exp(F.sum(F.log1p("ret")).over(w))).withColumn("day", business_day())
    day = value.groupBy("symbol", "day").agg(F.max_by("_v", "seq").alias("v"))
    days = day.groupBy("symbol").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).filter(F.weekday("day") < 5)
    own = W.partitionBy("symbol").orderBy("day")
    filled = days.join(day, ["symbol", "day"], "left").withColumn("v", F.last("v", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0)))
    return filled.withColumn("ret", F.col("v") / F.lag("v").over(own) - 1).filter("ret is not null").select("symbol", "day", "ret")


def signal_returns(df: DataFrame) -> DataFrame:
    """K8: signal times log price change."""
    return df.withColumn("ret", F.col("signal") * (F.log("price") - F.log(F.lag("price").over(W.partitionBy("symbol").orderBy("seq")))))


def performance(daily: DataFrame, by: str = "symbol", per_year: float = 252.0) -> DataFrame:
    """The usual statistics of daily returns (by, day, ret)."""
    w = W.partitionBy(by).orderBy("day")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    df = daily.withColumn("_v", F.exp(F.sum(F.log1p("ret")).over(run))).withColumn("_top", F.greatest(F.lit(1.0), F.max("_v").over(run)))
    df = df.withColumn("_n", F.row_number().over(w).cast("double")).withColumn("_l", F.log("_v"))
    m = df.groupBy(by).agg(
        F.count("*").alias("n"), F.max_by("_v", "day").alias("growth"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev"),
        F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0)))).alias("downside"), F.min(F.col("_v") / F.col("_top") - 1).alias("max_drawdown"),
        F.sum(F.greatest("ret", F.lit(0.0))).alias("gain"), F.sum(-F.least("ret", F.lit(0.0))).alias("loss"), F.regr_r2("_l", "_n").alias("stability"),
        F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurtosis"), F.percentile("ret", 0.95).alias("p95"), F.percentile("ret", 0.05).alias("p05"),
    )
    annual = F.pow("growth", per_year / F.col("n")) - 1
    return m.select(
        by, "n", (F.col("growth") - 1).alias("cumulative_return"), annual.alias("annual_return"), (F.col("dev") * per_year**0.5).alias("annual_volatility"),
        (F.try_divide("mean", "dev") * per_year**0.5).alias("sharpe"), (F.try_divide("mean", "downside") * per_year**0.5).alias("sortino"),
        F.try_divide(annual, F.abs("max_drawdown")).alias("calmar"), "max_drawdown", F.try_divide("gain", "loss").alias("omega"), "stability", "skew", "kurtosis",
        F.try_divide(F.abs("p95"), F.abs("p05")).alias("tail_ratio"), (F.col("mean") - 2 * F.col("dev")).alias("daily_var"),
    )


def against_benchmark(daily: DataFrame, benchmark: DataFrame, by: str = "symbol", per_year: float = 252.0) -> DataFrame:
    """Performance with alpha and beta to ``benchmark`` (by, day, bench)."""
    both = daily.join(benchmark, [by, "day"])
    fit = both.groupBy(by).agg(F.regr_slope("ret", "bench").alias("beta"), F.regr_intercept("ret", "bench").alias("_a"))
    return performance(daily, by, per_year).join(fit.select(by, "beta", (F.pow(1 + F.col("_a"), F.lit(per_year)) - 1).alias("alpha")), by)


def confusion(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of (label, pred)."""
    return scored.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label, with one aggregate of counts."""
    c = confusion(scored)
    t = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    df = t.join(p, "label", "left").withColumn("precision", F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("said")), F.lit(0.0))).withColumn("recall", F.col("hit") / F.col("support"))
    return df.select("label", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "support")


def roc(scored: DataFrame) -> DataFrame:
    """(score, fpr, tpr) at each distinct score from the top, for labels 0 and 1: sums by score first, then running sums over slices of scores."""
    s = cut(scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q")).withColumn("_down", -F.col("score")))
    total = s.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    run = sliced(s, [], ["_down"]).scan([Stage(["p", "q"], "_tp double, _fp double", Sums(2))]).df
    share = lambda c, n: F.try_divide(F.col(c), F.lit(float(n or 0)))
    return run.select("score", share("_fp", total["q"]).alias("fpr"), share("_tp", total["p"]).alias("tpr"))


def log_loss(scored: DataFrame) -> DataFrame:
    """Weighted log loss and accuracy of (label 0/1, score, w)."""
    p = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    hit = ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")
    return scored.agg((F.sum(loss * F.col("w")) / F.sum("w")).alias("log_loss"), (F.sum(hit * F.col("w")) / F.sum("w")).alias("accuracy"))
