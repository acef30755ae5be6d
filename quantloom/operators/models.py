"""Models, scores, tuning and importance over purged splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial, reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .learners import Logistic, fold_scores

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
#: Fits that go side by side.
AT_ONCE = 8


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


def _scored(df: DataFrame) -> DataFrame:
    """The probability of class 1 as score, and pred."""
    p = vector_to_array("probability")
    return df.withColumn("score", F.get(p, 1)).withColumn("pred", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def ml(estimator, features: list[str], scale: bool = False, pca: float | None = None, weight: str | None = "w", beside: list[str] = ()) -> Fit:
    """A fit of an MLlib classifier over named columns, scaled and reduced if asked; labels in ``label``.

    ``pca`` keeps the first components with that share of the variance. Columns ``beside`` are taken as they are, after the others;
    ``predict.names`` tells what each place of the model's vector is (M9).
    """

    def fit(train: DataFrame):
        stages = [_assembled(features)]
        names = list(features)
        column = "features"
        if scale or pca:
            stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True))
            column = "scaled"
        if pca:
            head = Pipeline(stages=stages).fit(train)
            full = PCA(k=len(features), inputCol=column, outputCol="_p").fit(head.transform(train))
            k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), pca) + 1)
            stages.append(PCA(k=min(k, len(features)), inputCol=column, outputCol="reduced"))
            column = "reduced"
            names = [f"PCA_{i}" for i in range(min(k, len(features)))]
        if beside:
            stages.append(VectorAssembler(inputCols=[column, *beside], outputCol="whole", handleInvalid="skip"))
            column = "whole"
            names += list(beside)
        e = estimator.copy({estimator.getParam("labelCol"): "label", estimator.getParam("featuresCol"): column})
        if weight and weight in train.columns and estimator.hasParam("weightCol"):
            e = e.copy({e.getParam("weightCol"): weight})
        model = Pipeline(stages=[*stages, e]).fit(train)

        def predict(df: DataFrame) -> DataFrame:
            out = model.transform(df)
            if "probability" not in out.columns:
                raw = F.get(vector_to_array("rawPrediction"), 1)
                return out.withColumn("score", 1 / (1 + F.exp(-raw))).withColumn("pred", F.col("prediction").cast("int")).drop("features", "scaled", "reduced", "whole", "rawPrediction", "prediction")
            return _scored(out).drop("scaled", "reduced", "whole")

        predict.model = model.stages[-1]
        predict.names = names
        return predict

    return fit


def random_forest(features: list[str], trees: int = 400, seed: int = 12) -> Fit:
    """M1."""
    return ml(RandomForestClassifier(numTrees=trees, featureSubsetStrategy="1", minWeightFractionPerNode=0.05, impurity="gini", seed=seed), features)


def bagged_forest(features: list[str], trees: int = 400, share: float = 1.0, seed: int = 12) -> Fit:
    """M5: entropy trees on samples of the mean uniqueness."""
    return ml(RandomForestClassifier(numTrees=trees, featureSubsetStrategy="1", impurity="entropy", subsamplingRate=max(0.01, min(1.0, share)), seed=seed), features)


def boosted_trees(features: list[str], rounds: int = 100, seed: int = 12) -> Fit:
    """M4."""
    return ml(GBTClassifier(maxDepth=3, stepSize=0.02, maxIter=rounds, seed=seed), features)


def linear_svc(features: list[str], rounds: int = 100) -> Fit:
    """M3 with a linear kernel and a logistic score of the margin; ``learners.rbf_svc`` has the radial kernel."""
    return ml(LinearSVC(maxIter=rounds), features, scale=True)


def gaussian_bayes(features: list[str]) -> Fit:
    """M7."""
    return ml(NaiveBayes(modelType="gaussian"), features)


def complement_bayes(features: list[str]) -> Fit:
    """M7: complement naive Bayes, over features scaled to 0..1, as it needs none below 0."""

    def fit(train: DataFrame):
        head = Pipeline(stages=[_assembled(features), MinMaxScaler(inputCol="features", outputCol="scaled")]).fit(train)
        within = lambda df: head.transform(df).withColumn("scaled", array_to_vector(F.transform(vector_to_array("scaled"), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))))
        model = NaiveBayes(modelType="complement", featuresCol="scaled", labelCol="label").fit(within(train))
        return lambda df: _scored(model.transform(within(df))).drop("scaled")

    return fit


def logistic(features: list[str], reg: float = 0.0) -> Fit:
    """Logistic regression on scaled features. Scores of many splits and candidates come from one pass a step (``learners.fold_scores``)."""
    fit = ml(LogisticRegression(regParam=reg), features, scale=True)
    fit.candidate = Logistic(features, reg)
    return fit


def adaboost(features: list[str], rounds: int = 20, depth: int = 1, seed: int = 12) -> Fit:
    """M2: SAMME over weighted stumps."""

    def fit(train: DataFrame):
        n = train.count()
        df = _assembled(features).transform(train).withColumn("_w", F.lit(1.0 / max(1, n)))
        models, alphas = [], []
        for k in range(rounds):
            m = DecisionTreeClassifier(maxDepth=depth, labelCol="label", weightCol="_w", seed=seed + k).fit(df)
            out = m.transform(df)
            miss = (F.col("prediction") != F.col("label")).cast("double")
            err, total = out.agg(F.sum(miss * F.col("_w")), F.sum("_w")).first()
            err = min(max((err or 0.0) / (total or 1.0), 1e-10), 1.0)
            if err >= 0.5:
                break
            alpha = float(np.log((1 - err) / err))
            models.append(m)
            alphas.append(alpha)
            df = out.withColumn("_w", F.col("_w") * F.exp(alpha * miss)).drop("prediction", "rawPrediction", "probability")
            if err <= 1e-10:
                break

        def predict(x: DataFrame) -> DataFrame:
            x = _assembled(features).transform(x)
            vote = F.lit(0.0)
            for m, a in zip(models, alphas, strict=True):
                x = m.transform(x).withColumn("_v", vote + a * (2 * F.col("prediction") - 1)).drop("prediction", "rawPrediction", "probability")
                x = x.withColumn("_vote", F.col("_v")).drop("_v")
                vote = F.col("_vote")
            x = x if models else x.withColumn("_vote", F.lit(0.0))
            score = 1 / (1 + F.exp(-F.col("_vote")))
            return x.withColumn("score", score).withColumn("pred", (F.col("_vote") > 0).cast("int")).drop("_vote", "features")

        return predict

    return fit


def bagged_single_features(features: list[str], rounds: int = 20, share: float = 0.5, seed: int = 12) -> Fit:
    """M6: entropy trees of one feature each, on samples, that vote."""

    def fit(train: DataFrame):
        models = []
        for k in range(rounds):
            f = features[(seed + k) % len(features)]
            models.append(ml(DecisionTreeClassifier(impurity="entropy", seed=seed + k), [f])(train.sample(share, seed=seed + k)))

        def predict(x: DataFrame) -> DataFrame:
            keep = x.columns
            x = x.withColumn("_s", F.lit(0.0))
            for m in models:
                x = m(x).withColumn("_s", F.col("_s") + F.col("score")).select(*keep, "_s")
            return x.withColumn("score", F.col("_s") / len(models)).withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop("_s")

        return predict

    return fit


@contextmanager
def _parts(rows: DataFrame, roles: DataFrame, *more: str) -> Iterator[list[tuple[int, DataFrame, DataFrame]]]:
    """(split, train, test) of each split. The rows with their roles are made once for all fits: each reads them many times, and, as they lie
    in the order of splits and roles, little of what is not its own."""
    both = rows.join(roles.filter("role <> 'dropped'").select("symbol", "pos", "split", "role", *more), ["symbol", "pos"])
    both = both.sortWithinPartitions("split", "role", "symbol", "pos").persist()
    try:
        part = lambda k, role: both.filter((F.col("split") == k) & (F.col("role") == role)).drop("split", "role")
        yield [(k, part(k, "train"), part(k, "test")) for k in sorted(r.split for r in both.select("split").distinct().collect())]
    finally:
        both.unpersist()


def _side_by_side(spark, jobs: list[Callable[[], Any]]) -> list:
    """What ``jobs`` give, in their order. Each is a chain of short Spark jobs, which leaves most cores idle: AT_ONCE of them go side by side."""
    with ThreadPool(min(AT_ONCE, max(1, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def _score(scored: DataFrame, scoring: str) -> float | None:
    from .backtest import log_loss

    if scoring == "f1":
        hits, found = F.sum(((F.col("label") == 1) & (F.col("pred") == 1)).cast("long")), F.sum((F.col("label") == 1).cast("long") + F.col("pred"))
        return scored.agg(F.coalesce(F.try_divide(2.0 * hits, found), F.lit(0.0))).first()[0]
    s = log_loss(scored if "w" in scored.columns else scored.withColumn("w", F.lit(1.0))).first()
    return s.accuracy if scoring == "accuracy" else None if s.log_loss is None else -s.log_loss


def _fit_score(fit: Fit, train: DataFrame, test: DataFrame, scoring: str) -> float | None:
    return _score(fit(train)(test), scoring)


def _all_scores(rows: DataFrame, roles: DataFrame, fits: dict[str, Fit], scoring: str) -> DataFrame:
    """(model, split, score): one number for each fit and split."""
    if scoring not in ("log_loss", "accuracy", "f1"):
        raise ValueError(f"unknown scoring {scoring}")
    at_once = {name: fit.candidate for name, fit in fits.items() if hasattr(fit, "candidate")}
    out = fold_scores(rows, roles, at_once, scoring) if at_once else None
    if len(at_once) == len(fits):
        return out
    with _parts(rows, roles) as parts:
        todo = [(name, fit, *part) for name, fit in fits.items() if name not in at_once for part in parts]
        got = _side_by_side(rows.sparkSession, [partial(_fit_score, fit, train, test, scoring) for _, fit, _, train, test in todo])
    scores = [(name, k, score) for (name, _, k, _, _), score in zip(todo, got, strict=True)]
    rest = rows.sparkSession.createDataFrame(scores, "model string, split int, score double")
    return rest if out is None else out.union(rest)


def cv_scores(rows: DataFrame, roles: DataFrame, fit: Fit, scoring: str = "log_loss") -> DataFrame:
    """(split, score) over roles (symbol, split, pos, role); log loss is negative, so that more is better; f1 is that of label 1, unweighted."""
    return _all_scores(rows, roles, {"": fit}, scoring).drop("model")


def scores(rows: DataFrame, roles: DataFrame, fits: dict[str, Fit], scoring: str = "log_loss") -> DataFrame:
    """(model, split, score) of several fits."""
    return _all_scores(rows, roles, fits, scoring)


def compare(rows: DataFrame, roles: DataFrame, fits: dict[str, Fit], scoring: str = "log_loss") -> DataFrame:
    """(model, mean, std) over the splits."""
    return _all_scores(rows, roles, fits, scoring).groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))


def grid(make: Callable[..., Fit], values: dict[str, list]) -> dict[str, Fit]:
    """A candidate for each combination of ``values``, named by them."""
    return {", ".join(f"{k}={v}" for k, v in zip(values, c, strict=True)): make(**dict(zip(values, c, strict=True))) for c in product(*values.values())}


def drawn(make: Callable[..., Fit], ranges: dict[str, tuple[float, float]], n: int, seed: int = 1) -> dict[str, Fit]:
    """``n`` candidates with log-uniform values of the ``ranges``."""
    rng = np.random.default_rng(seed)
    sets = [{k: float(a * (b / a) ** rng.random()) for k, (a, b) in ranges.items()} for _ in range(n)]
    return {", ".join(f"{k}={v:.6g}" for k, v in s.items()): make(**s) for s in sets}


def bagged(fit: Fit, rounds: int = 10, share: float = 1.0, seed: int = 12) -> Fit:
    """M14's bagging: ``rounds`` fits on draws with replacement of that share of the rows; their mean score is the score."""

    def bag(train: DataFrame):
        models = [fit(train.sample(True, share, seed + k)) for k in range(rounds)]

        def predict(x: DataFrame) -> DataFrame:
            keep = x.columns
            x = x.withColumn("_s", F.lit(0.0))
            for m in models:
                x = m(x).withColumn("_s", F.col("_s") + F.col("score")).select(*keep, "_s")
            return x.withColumn("score", F.col("_s") / len(models)).withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop("_s")

        return predict

    return bag


def tuned(rows: DataFrame, roles: DataFrame, candidates: dict[str, Fit], scoring: str = "log_loss", bagging: int = 0, share: float = 1.0) -> tuple[str, Callable]:
    """The name of the best candidate over purged splits, and its fit on all rows, bagged if ``bagging`` rounds are asked for."""
    best = compare(rows, roles, candidates, scoring).orderBy(F.col("mean").desc(), "model").first()
    fit = candidates[best.model]
    return best.model, (bagged(fit, bagging, share) if bagging else fit)(rows)


def importance_mdi(model, features: list[str], spark) -> DataFrame:
    """(feature, mean, std) over the trees, zeros left out, scaled to sum 1."""
    each = np.array([t.featureImportances.toArray() for t in model.trees])
    each = np.where(each == 0, np.nan, each)
    with np.errstate(all="ignore"):
        n = (~np.isnan(each)).sum(axis=0)
        mean = np.where(n > 0, np.nansum(each, axis=0) / np.maximum(n, 1), 0.0)
        dev = np.sqrt(np.nansum((each - mean) ** 2, axis=0) / np.maximum(n - 1, 1)) * len(each) ** -0.5
    total = mean.sum() or 1.0
    return spark.createDataFrame([(f, float(m / total), float(s / total)) for f, m, s in zip(features, mean, dev, strict=True)], "feature string, mean double, std double")


def permuted(df: DataFrame, column: str, seed: int) -> DataFrame:
    """``df`` with ``column`` shuffled within each symbol: two numberings, one join."""
    key = F.row_number().over(W.partitionBy("symbol").orderBy("pos"))
    drawn = F.row_number().over(W.partitionBy("symbol").orderBy(F.xxhash64("pos", F.lit(seed)), "pos"))
    other = df.select("symbol", drawn.alias("_k"), F.col(column).alias("_v"))
    return df.withColumn("_k", key).join(other, ["symbol", "_k"]).withColumn(column, F.col("_v")).drop("_k", "_v")


def importance_mda(rows: DataFrame, roles: DataFrame, fit: Fit, features: list[str], seed: int = 1) -> DataFrame:
    """(feature, mean, std): the share of the log loss that shuffling a feature in the test rows costs."""
    drops: dict[str, list[float]] = {f: [] for f in features}
    with _parts(rows, roles) as parts:
        for _, train, test in parts:
            model = fit(train)
            s0 = _score(model(test), "log_loss")
            for f in features:
                s1 = _score(model(permuted(test, f, seed)), "log_loss")
                drops[f].append((s1 - s0) / s1 if s1 else 0.0)
    data = [(f, float(np.mean(x)), float(np.std(x, ddof=1) * len(x) ** -0.5) if len(x) > 1 else 0.0) for f, x in drops.items()]
    return rows.sparkSession.createDataFrame(data, "feature string, mean double, std double")


def importance_sfi(rows: DataFrame, roles: DataFrame, make: Callable[[list[str]], Fit], features: list[str], scoring: str = "log_loss") -> DataFrame:
    """(feature, mean, std): scores of models of one feature each."""
    s = _all_scores(rows, roles, {f: make([f]) for f in features}, scoring).groupBy(F.col("model").alias("feature"))
    return s.agg(F.avg("score").alias("mean"), (F.stddev_pop("score") * F.pow(F.count("*"), F.lit(-0.5))).alias("std"))


def importance(rows: DataFrame, roles: DataFrame, features: list[str], method: str = "SFI", trees: int = 1000, scoring: str = "accuracy") -> tuple[DataFrame, float, float]:
    """(importance, oob, oos) of a bagged entropy forest; oob is the score on a tenth of the rows, by hash, that a fit on the rest has not seen."""
    if method not in ("MDI", "MDA", "SFI"):
        raise ValueError(f"unknown method {method}")
    make = lambda f: bagged_forest(f, trees)
    held = F.pmod(F.xxhash64("symbol", "pos"), F.lit(10)) == 0
    oob = cv_scores(rows, rows.select("symbol", "pos", F.lit(0).alias("split"), F.when(held, "test").otherwise("train").alias("role")), make(features), scoring).first().score
    oos = cv_scores(rows, roles, make(features), scoring).agg(F.avg("score")).first()[0]
    if method == "MDI":
        imp = importance_mdi(make(features)(rows).model, features, rows.sparkSession)
    elif method == "MDA":
        imp = importance_mda(rows, roles, make(features), features)
    else:
        imp = importance_sfi(rows, roles, make, features, scoring)
    return imp, float(oob), float(oos)


def importance_experiment(problem: DataFrame, methods: tuple[str, ...] = ("MDI", "MDA", "SFI"), trees: int = 100, folds: int = 10) -> DataFrame:
    """(method, I, R, N, oob, oos): the shares of importance that informative, redundant and noise features of a synthetic problem (S12) get."""
    from .splits import purged_kfold

    rows = problem.select(F.lit("synthetic").alias("symbol"), F.col("id").alias("pos"), F.col("bin").alias("label"), "w", *(c for c in problem.columns if c[:2] in ("I_", "R_", "N_")))
    features = rows.columns[4:]
    roles = purged_kfold(rows.select("symbol", "pos", F.col("pos").alias("pred"), F.col("pos").alias("eval")), folds)
    out = None
    for m in methods:
        imp, oob, oos = importance(rows, roles, features, m, trees)
        total = F.sum(F.abs("mean"))
        s = imp.agg(*(F.try_divide(F.sum(F.when(F.substring("feature", 1, 1) == t, F.col("mean")).otherwise(0.0)), total).alias(t) for t in "IRN"))
        s = s.select(F.lit(m).alias("method"), "I", "R", "N", F.lit(oob).alias("oob"), F.lit(oos).alias("oos"))
        out = s if out is None else out.union(s)
    return out


def orthogonal(df: DataFrame, features: list[str], share: float = 0.95) -> DataFrame:
    """Df with o_0, o_1, ...: the standardised features on the eigenvectors with ``share`` of the variance; the moments are one aggregate."""
    stats = df.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_samp(f).alias(f"s_{f}") for f in features)).first()
    z = {f: (F.col(f) - (stats[f"m_{f}"] or 0.0)) / (stats[f"s_{f}"] or 1.0) for f in features}
    dots = df.agg(*(F.sum(z[a] * z[b]).alias(f"{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j <= i)).first()
    m = np.zeros((len(features), len(features)))
    for i in range(len(features)):
        for j in range(i + 1):
            m[i, j] = m[j, i] = dots[f"{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(m)
    order = values.argsort()[::-1]
    values, vectors = values[order], vectors[:, order]
    k = int(np.searchsorted(np.cumsum(values) / (values.sum() or 1.0), share) + 1)
    return df.withColumns({f"o_{c}": sum((z[f] * float(vectors[i, c]) for i, f in enumerate(features)), F.lit(0.0)) for c in range(min(k, len(features)))})


def scaled(train: DataFrame, test: DataFrame, features: list[str], kind: str = "standard") -> tuple[DataFrame, DataFrame]:
    """Both frames scaled by the training rows: to mean 0 and population deviation 1, or to [0, 1] (kind 'range')."""
    low, size = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
    s = train.agg(*(low(f).alias(f"a_{f}") for f in features), *(size(f).alias(f"b_{f}") for f in features)).first()
    cols = {f: (F.col(f) - (s[f"a_{f}"] or 0.0)) / (s[f"b_{f}"] or 1.0) for f in features}
    return train.withColumns(cols), test.withColumns(cols)


def min_max(fit: Fit, features: list[str]) -> Fit:
    """``fit`` over features scaled to 0..1 by the training rows' ranges; what lies outside of these is not cut off, a feature without a range becomes 0."""

    def scaled(train: DataFrame):
        r = train.agg(*(F.min(f) for f in features), *(F.max(f) for f in features)).first()
        low, high = r[: len(features)], r[len(features) :]

        def to(df: DataFrame) -> DataFrame:
            own = {f: F.col(f) for f in features}
            kept = df.withColumns({f"_raw_{f}": c for f, c in own.items()})
            return kept.withColumns({f: (F.col(f) - a) / (b - a) if a is not None and b > a else F.lit(0.0) for f, a, b in zip(features, low, high, strict=True)})

        model = fit(to(train))

        def predict(df: DataFrame) -> DataFrame:
            out = model(to(df))
            return out.withColumns({f: F.col(f"_raw_{f}") for f in features}).drop(*(f"_raw_{f}" for f in features))

        return predict

    return scaled


def cpcv_run(rows: DataFrame, roles: DataFrame, fit: Fit, classes: int = 2, step: float | None = None, side: str | None = None, sized: bool = True) -> DataFrame:
    """(symbol, pos, group, split, signal): each split's predictions of its test rows.

    ``sized`` (K3, K4, P4): bet sizes of the greater class's probability, times ``side`` if there is one, in steps if asked. Otherwise (K2, P3) the
    predicted label of -1 and 1 times its probability and ``side``. ``min_max(fit, features)`` scales by each split's training rows. Rows and
    roles are made once for all splits.
    """
    from ..functions.scalar import discrete, signal

    out = []
    with _parts(rows, roles, "fold") as parts:
        for k, train, test in parts:
            scored = fit(train)(test)
            prob, sign = F.greatest("score", 1 - F.col("score")), 2 * F.col("pred") - 1
            own = F.lit(1.0) if side is None else F.col(side)
            s = signal(prob, sign, classes, None if side is None else own) if sized else sign * prob * own
            told = scored.select("symbol", "pos", F.col("fold").alias("group"), F.lit(k).alias("split"), (discrete(s, step) if sized and step is not None else s).cast("double").alias("signal"))
            out.append(cut(told))
    return reduce(DataFrame.union, out)


def importance_plot(importance: DataFrame, oob: float, oos: float) -> DataFrame:
    """What the plot shows: (place, feature, mean, std, oob, oos), the least important feature at place 1."""
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("mean", "feature"))  # a row a feature
    return importance.select(place.alias("place"), "feature", "mean", "std", F.lit(float(oob)).alias("oob"), F.lit(float(oos)).alias("oos"))


def bootstrapped_forest(features: list[str], spans: str = "i0", ends: str = "i1", trees: int = 10, seed: int = 12) -> Fit:
    """Trees on rows drawn by the sequential bootstrap, the draw lists of all trees and symbols in parallel, that vote.

    Rows themselves are not sent to the draws: they are repeated as often as their key was drawn.
    """

    def fit(train: DataFrame):
        from .weights import bootstrap_counts

        models = []
        drawn = cut(bootstrap_counts(train, [seed + k for k in range(trees)], spans, ends))
        for k in range(trees):
            times = drawn.filter(F.col("seed") == seed + k).drop("seed")
            rows = train.join(times, ["symbol", "pos"]).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "_again")
            models.append(ml(DecisionTreeClassifier(seed=seed + k), features)(rows))

        def predict(x: DataFrame) -> DataFrame:
            keep = x.columns
            x = x.withColumn("_s", F.lit(0.0))
            for m in models:
                x = m(x).withColumn("_s", F.col("_s") + F.col("score")).select(*keep, "_s")
            return x.withColumn("score", F.col("_s") / len(models)).withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop("_s")

        return predict

    return fit
