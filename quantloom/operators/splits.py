"""Cross-validation splits with purging and embargo (C1-C12), and combinatorial paths (K1)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..session import cut
from ..sources.tape import micros
from .slices import Stage, Sums, Tops, sliced


def _number(df: DataFrame, c: str) -> Column:
    """A time as a whole number: microseconds of timestamps, days of dates, or the number itself."""
    kind = df.schema[c].dataType
    if isinstance(kind, TimestampNTZType):
        return micros(f"`{c}`")
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    return F.datediff(F.col(c), F.lit("1970-01-01")).cast("long") if isinstance(kind, DateType) else F.col(c).cast("long")


def train_times(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows (t0, t1) that overlap none of ``tests`` (t0, t1), ends included; times are whole numbers, timestamps or dates.

    A row overlaps a test if and only if the greatest end of those that start by its own end is at or after its start, which a running
    maximum over slices of both finds. Rows or tests with a null time overlap nothing; such a row is left out.
    """
    least = -(1 << 63)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(f"_{c}") for c in rows.columns]
    t = tests.select(_number(tests, "t0").alias("t"), _number(tests, "t1").alias("e"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("start"), *none).filter("t is not null and e is not null")
    r = rows.select(_number(rows, "t1").alias("t"), F.lit(least).alias("e"), F.lit(1).alias("k"), _number(rows, "t0").alias("start"), *(F.col(c).alias(f"_{c}") for c in rows.columns))
    both = sliced(t.union(r.filter("t is not null and start is not null")), [], ["t", "k"]).scan([Stage(["e"], "m long", Tops())]).df
    return both.filter("k = 1 and m < start").select(*(F.col(f"_{c}").alias(c) for c in rows.columns))


def embargo_times(times: DataFrame, share: float) -> DataFrame:
    """(t, until): the time int(n * share) places on, the last one at the end. Places come from slices, and are joined."""
    step = int(times.count() * share)
    if not step:
        return times.select("t", F.col("t").alias("until"))
    at = cut(sliced(times.select("t", F.lit(1).cast("long").alias("one")), [], ["t"]).scan([Stage(["one"], "i long", Sums(1, np.int64))]).df)
    last = at.agg(F.max("t")).first()[0]
    later = at.select((F.col("i") - step).alias("i"), F.col("t").alias("later"))
    return at.join(later, "i", "left").select("t", F.coalesce("later", F.lit(last).cast(times.schema["t"].dataType)).alias("until"))


def embargo_duration(times: DataFrame, share: float = 0.01) -> int:
    """The span of the first ``share`` of the times."""
    n = times.count()
    r = times.orderBy("t").limit(max(1, int(share * n))).agg(F.max("t") - F.min("t")).first()
    return r[0] or 0


def folded(rows: DataFrame, folds: int, by_time: bool = False) -> DataFrame:
    """Rows (symbol, pos, pred, eval) with their fold, of equal counts (the first ones larger) or of equal time."""
    if by_time:
        every = W.partitionBy("symbol")
        span = F.max("pred").over(every) - F.min("pred").over(every) + 1
        return rows.withColumn("fold", F.floor((F.col("pred") - F.min("pred").over(every)) * folds / span).cast("int"))
    return rows.withColumn("fold", F.ntile(folds).over(W.partitionBy("symbol").orderBy("pos")) - 1)


def _blocks(rows: DataFrame, splits: list[list[int]], folds: int) -> DataFrame:
    """(symbol, split, block, s, e, pred_s, eval_m): for each split its test blocks of neighbouring folds."""
    made = []
    for k, test in enumerate(splits):
        start = 0
        for n in range(1, len(test) + 1):
            if n == len(test) or test[n] != test[n - 1] + 1:
                made.append((k, len(made), test[start], test[n - 1]))
                start = n
    blocks = rows.sparkSession.createDataFrame(made, "split int, block int, first int, last int")
    bounds = rows.groupBy("symbol", "fold").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min("pred").alias("p"), F.max("eval").alias("m"))
    met = bounds.join(F.broadcast(blocks), F.col("fold").between(F.col("first"), F.col("last")))  # folds of a symbol: a handful
    return met.groupBy("symbol", "split", "block").agg(F.min("a").alias("s"), (F.max("b") + 1).alias("e"), F.min("p").alias("pred_s"), F.max("m").alias("eval_m"))


def _roles(rows: DataFrame, splits: list[list[int]], folds: int, embargo: int, train_folds: dict[int, list[int]] | None = None) -> DataFrame:
    """(symbol, split, pos, fold, role): role is test, train, or dropped."""
    blocks = _blocks(rows, splits, folds)
    # how many rows are predicted by the cutoff of each block: with that, the embargo is a position
    cut = blocks.withColumn("cutoff", F.col("eval_m") + embargo)
    both = cut.select("symbol", F.col("cutoff").alias("t"), F.lit(1).alias("k"), "split", "block", F.lit(0).alias("one")).union(
        rows.select("symbol", F.col("pred").alias("t"), F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1))
    )
    w = W.partitionBy("symbol").orderBy("t", "k").rowsBetween(W.unboundedPreceding, 0)
    upto = both.withColumn("upto", F.sum("one").over(w)).filter("k = 1").select("symbol", "split", "block", "upto")
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    blocks = blocks.join(upto, ["symbol", "split", "block"]).join(n, "symbol")
    # one row a symbol: for each split its blocks; a row looks them up where it is, so rows times blocks are not shuffled
    held = blocks.groupBy("symbol", "split").agg(F.collect_list(F.struct("s", "e", "pred_s", "upto", "n")).alias("blocks"))
    held = held.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("split", "blocks"))).alias("splits"))
    inside = lambda b: (F.col("pos") >= b["s"]) & (F.col("pos") < b["e"])
    free = lambda b: (F.col("eval") < b["pred_s"]) | ((F.col("pos") >= b["e"]) & ((b["upto"] == b["n"]) | (F.col("pos") >= b["upto"])))
    may_train = lambda x: F.forall(x["blocks"], free)
    if train_folds is not None:
        folds_of = F.array(*(F.array(*map(F.lit, train_folds[k])) for k in range(len(splits)))) if splits else F.array(F.array().cast("array<int>"))
        may_train = lambda x: F.array_contains(F.get(folds_of, x["split"]), F.col("fold")) & F.forall(x["blocks"], free)
    role = lambda x: F.when(F.exists(x["blocks"], inside), "test").when(may_train(x), "train").otherwise("dropped")
    every = rows.join(held, "symbol").select("symbol", "pos", "fold", F.explode(F.transform("splits", lambda x: F.struct(x["split"].alias("split"), role(x).alias("role")))).alias("x"))
    return every.select("symbol", "x.split", "pos", "fold", "x.role")


def purged_kfold(rows: DataFrame, folds: int = 3, share: float = 0.0) -> DataFrame:
    """Each fold tests once; on its left rows that end by its start train, on its right those past its last end and the embargo."""
    r = folded(rows, folds)
    n = r.groupBy("symbol").agg(F.count("*").alias("n"))
    b = r.groupBy("symbol", F.col("fold").alias("split")).agg(F.min("pos").alias("s"), F.max("pos").alias("e"), F.min("pred").alias("pred_s"), F.max("eval").alias("m"))
    both = b.select("symbol", F.col("m").alias("t"), F.lit(0).alias("k"), "split", F.lit(0).alias("one")).union(r.select("symbol", F.col("pred"), F.lit(1), F.lit(None).cast("int"), F.lit(1)))
    w = W.partitionBy("symbol").orderBy("t", "k").rowsBetween(W.unboundedPreceding, 0)
    before = both.withColumn("before", F.sum("one").over(w)).filter("k = 0").select("symbol", "split", "before")  # rows strictly before the last end
    b = b.join(before, ["symbol", "split"]).join(n, "symbol")
    every = r.join(b, "symbol")
    test = F.col("pos").between(F.col("s"), F.col("e"))
    train = ((F.col("pos") < F.col("s")) & (F.col("eval") <= F.col("pred_s"))) | ((F.col("pos") > F.col("e")) & (F.col("pos") >= F.col("before") + F.floor(F.col("n") * share)))
    return every.select("symbol", "split", "pos", "fold", F.when(test, "test").when(train, "train").otherwise("dropped").alias("role"))


def walk_forward(rows: DataFrame, folds: int = 10, test_folds: int = 1, least_train: int = 2, most_train: int | None = None) -> DataFrame:
    """A split for each fold that has ``least_train`` folds before it; it tests ``test_folds`` folds and trains on those before."""
    r = folded(rows, folds)
    splits, train = [], {}
    for j in range(least_train, folds - test_folds + 1):
        train[len(splits)] = list(range(max(0, j - (most_train or folds)), j))
        splits.append(list(range(j, j + test_folds)))
    return _roles(r, splits, folds, 0, train)


def cpcv_splits(folds: int, test_folds: int) -> list[list[int]]:
    """The test folds of each split: the combinations, in order."""
    return [list(x) for x in combinations(range(folds), test_folds)]


def cpcv(rows: DataFrame, folds: int = 10, test_folds: int = 2, embargo: int = 0) -> DataFrame:
    """All combinations of ``test_folds`` folds, purged and with an embargo in units of pred, for each run of test folds."""
    if not 2 <= folds or not 1 <= test_folds < folds:
        raise ValueError("needs 2 folds or more, and fewer test folds")
    return _roles(folded(rows, folds), cpcv_splits(folds, test_folds), folds, embargo)


def cpcv_paths(spark: SparkSession, folds: int, test_folds: int = 2) -> DataFrame:
    """K1: (path, group, split): each group's k-th split, by the numbers of ``cpcv_splits``, is its part of path k."""
    made = []
    for g in range(folds):
        for path, k in enumerate(k for k, c in enumerate(cpcv_splits(folds, test_folds)) if g in c):
            made.append((path, g, k))
    return spark.createDataFrame(made, "path int, group int, split int")
