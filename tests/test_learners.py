"""Learners against plain forms of them."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import learners, models, splits


def frame(spark, x, y, w=None):
    rows = [("a" if k % 3 else "b", k, *map(float, r), int(label), 1.0 if w is None else float(w[k])) for k, (r, label) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "symbol string, pos long, " + ", ".join(f"x{j} double" for j in range(len(x[0]))) + ", label int, w double")


def rings(n, seed):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    r, a = np.where(y == 1, 2.5, 1.0) + 0.15 * rng.standard_normal(n), rng.uniform(0, 2 * np.pi, n)
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1), y


def test_rings_are_told_apart_by_the_radial_kernel(spark):
    x, y = rings(900, 1)
    keep = (y == 0) | (np.arange(900) % 6 == 1)  # labels of 3 to 1
    train, (tx, ty) = frame(spark, x[keep], y[keep]), rings(300, 2)
    model = learners.rbf_svc(["x0", "x1"], rounds=30)(train)
    test = frame(spark, tx, ty).union(spark.createDataFrame([("c", 1, None, 1.0, 0, 1.0)], "symbol string, pos long, x0 double, x1 double, label int, w double"))
    got = {(r.symbol, r.pos): r for r in model(test).collect()}
    assert got["c", 1].score == 0.5
    pairs = [(got["a" if k % 3 else "b", k].score, label) for k, label in enumerate(ty)]
    assert np.mean([(p >= 0.5) == label for p, label in pairs]) > 0.97
    loss = -np.mean([math.log(p if label else 1 - p) for p, label in pairs])
    assert loss < 0.15
    straight = models.linear_svc(["x0", "x1"], 10)(train)(frame(spark, tx, ty)).collect()
    assert np.mean([r.pred == r.label for r in straight]) < 0.8


def test_margins_are_calibrated(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal(4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(1.7 * m - 0.6)))
    slope, shift = learners._platt(spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, y, strict=True)], "m double, label double"))
    assert slope == pytest.approx(1.7, abs=0.15) and shift == pytest.approx(-0.6, abs=0.12)


def plain_boost(x, y, w, edges, rounds, depth, rate, reg, least):
    """Second-order boosting over the same edges, node by node."""
    m = np.zeros(len(x))

    def grow(rows, left):
        p = 1 / (1 + np.exp(-m[rows]))
        g, h = (p - y[rows]) * w[rows], p * (1 - p) * w[rows]
        value = -rate * g.sum() / (h.sum() + reg)
        best = (1e-12, None)
        for f in range(x.shape[1]) if left else ():
            for e in edges[f]:
                low = x[rows, f] <= e
                gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
                gain = 0.5 * (gl**2 / (hl + reg) + gr**2 / (hr + reg) - g.sum() ** 2 / (h.sum() + reg))
                if hl >= least and hr >= least and gain > best[0] + 1e-12:
                    best = (gain, (f, e))
        if best[1] is None:
            return [(rows, value)]
        low = x[rows, best[1][0]] <= best[1][1]
        return grow(rows[low], left - 1) + grow(rows[~low], left - 1)

    for _ in range(rounds):
        step = np.zeros(len(x))
        for rows, value in grow(np.arange(len(x)), depth):
            step[rows] = value
        m = m + step
    return m


def test_boosted_trees_are_those_of_a_plain_form(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(500) < 0.1)).astype(int)
    w = rng.uniform(0.5, 2, 500)
    df, names = frame(spark, x, y, w).repartition(3), ["x0", "x1", "x2"]
    model = learners.newton_trees(names, rounds=6, depth=3, rate=0.3, bins=16)(df)
    want = plain_boost(x, y, w, learners.quantile_edges(df, names, 16), 6, 3, 0.3, 1.0, 1.0)
    p = {r.pos: r.score for r in model(df).collect()}
    loss = lambda q: -np.average([math.log(a if b else 1 - a) for a, b in zip(q, y, strict=True)], weights=w)
    got, plain = [p[k] for k in range(500)], 1 / (1 + np.exp(-want))
    assert loss(got) == pytest.approx(loss(plain), abs=1e-9)
    assert np.abs(np.array(got) - plain).max() < 1e-9 and loss(got) < 0.6


@pytest.mark.parametrize("block", [16_384, 20])
def test_neighbours_are_the_nearest_ones(spark, block):
    rng = np.random.default_rng(7)
    x = np.round(rng.standard_normal((400, 2)) * np.where(np.arange(400) % 2, 1.0, 6.0)[:, None], 1)
    y = rng.integers(0, 2, 400)
    train, asks = frame(spark, x, y).repartition(3), np.round(rng.standard_normal((80, 2)) * 4, 1)
    model = learners.nearest_neighbours(["x0", "x1"], 7, cells=12, block=block)(train)
    mean, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
    got = {r.pos: r.score for r in model(frame(spark, asks, [0] * 80)).collect()}
    order = {k: ("a" if k % 3 else "b", k) for k in range(400)}
    for q, v in enumerate(asks):
        d = np.round(np.sqrt(((((x - mean) / spread) - (v - mean) / spread) ** 2).sum(axis=1)), 9)
        near = sorted(range(400), key=lambda k: (d[k], order[k]))[:7]  # noqa: B023
        far = d[near[-1]]
        sure = [k for k in range(400) if d[k] < far]
        ties = 7 - len(sure)
        low, high = (sum(y[k] for k in sure) + e for e in (0, ties))
        assert low / 7 - 1e-9 <= got[q] <= high / 7 + 1e-9
        if sum(d == far) == ties:
            assert got[q] == pytest.approx(np.mean(y[near]))
    few = learners.nearest_neighbours(["x0", "x1"], 7)(frame(spark, x[:3], y[:3]))(frame(spark, asks[:2], [0, 0])).collect()
    assert all(r.score == pytest.approx(y[:3].mean()) for r in few)


def test_all_splits_and_candidates_at_once(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 3)) * [1, 10, 0.1] + [0, 5, 1]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] + 0.1 * (x[:, 1] - 5))))).astype(int)
    rows = frame(spark, x, y).withColumn("symbol", F.lit("a"))
    roles = splits.purged_kfold(rows.select("symbol", "pos", F.col("pos").alias("pred"), (F.col("pos") + 1).alias("eval")), 3, 0.01)
    names = ["x0", "x1", "x2"]
    for scoring in ("log_loss", "accuracy", "f1"):
        got = {(r.model, r.split): r.score for r in learners.fold_scores(rows, roles, {"all": learners.Logistic(names), "one": learners.Logistic(["x0"])}, scoring).collect()}
        assert len(got) == 6
        if scoring == "log_loss":
            for name, fs in (("all", names), ("one", ["x0"])):
                fit = models.ml(models.LogisticRegression(tol=1e-10, maxIter=200), fs, scale=True)
                with models._parts(rows, roles) as parts:
                    for k, train, test in parts:
                        assert got[name, k] == pytest.approx(models._score(fit(train)(test), scoring), abs=1e-5)
    # jobs do not grow with candidates
    sc = spark.sparkContext
    counts = []
    for n in (1, 5):
        sc.setJobGroup(f"sweep{n}", "")
        learners.fold_scores(rows, roles, {str(k): learners.Logistic(names[: 1 + k % 3], 0.01 * k) for k in range(n)}, rounds=4, tolerance=0.0)
        counts.append(len(sc.statusTracker().getJobIdsForGroup(f"sweep{n}")))
        sc.setJobGroup("", "")
    assert counts[0] == counts[1]


def test_complement_bayes(spark):
    rng = np.random.default_rng(2)
    y = np.arange(200) % 2
    x = rng.uniform(0, 1, (200, 2)) + np.stack([y * 3.0, (1 - y) * 3.0], axis=1) - 1
    got = models.complement_bayes(["x0", "x1"])(frame(spark, x, y))(frame(spark, x * 1.5 - 1, y)).collect()
    assert np.mean([r.pred == r.label for r in got]) > 0.9


def test_each_split_is_scaled_by_its_own_training_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 2)) * [3, 0.5] + np.arange(120)[:, None] / 40
    y = (x[:, 0] + rng.standard_normal(120) > 1.5).astype(int)
    rows = frame(spark, x, y).withColumn("symbol", F.lit("a")).withColumn("side", F.when(F.col("pos") % 2 == 0, 1.0).otherwise(-1.0))
    roles = splits.cpcv(rows.select("symbol", "pos", F.col("pos").alias("pred"), (F.col("pos") + 1).alias("eval")), 3, 1, 2)
    names, seen = ["x0", "x1"], []

    def looking(train):
        seen.append(train.agg(*(f(c) for c in names for f in (F.min, F.max))).first())
        return lambda df: df.withColumn("score", F.least(F.greatest(F.col("x0"), F.lit(0.0)), F.lit(1.0))).withColumn("pred", (F.col("x0") >= 0.5).cast("int"))

    got = models.cpcv_run(rows, roles, models.min_max(looking, names), side="side", sized=False).collect()
    assert all(tuple(r) == pytest.approx((0, 1, 0, 1)) for r in seen) and len(seen) == 3
    parts = {(r.split, r.pos): r.role for r in roles.collect()}
    for r in got:
        train = x[[p for p in range(120) if parts[r.split, p] == "train"], 0]
        v = (x[r.pos, 0] - train.min()) / (train.max() - train.min())
        p = min(max(v, 0.0), 1.0)
        assert r.signal == pytest.approx((1 if v >= 0.5 else -1) * max(p, 1 - p) * (1 if r.pos % 2 == 0 else -1))
    assert len(got) == sum(role == "test" for role in parts.values())


def test_places_of_a_model_have_names(spark):
    rng = np.random.default_rng(6)
    z = rng.standard_normal((200, 2))
    x = np.stack([z[:, 0], z[:, 0] * 2 + 0.01 * z[:, 1], z[:, 1], np.arange(200) % 2], axis=1)
    fit = models.ml(models.LogisticRegression(), ["x0", "x1", "x2"], scale=True, pca=0.95, beside=["x3"])
    model = fit(frame(spark, x, (z[:, 0] > 0).astype(int)))
    assert model.names == ["PCA_0", "PCA_1", "x3"] and model.model.numFeatures == 3
    plot = models.importance_plot(spark.createDataFrame([("a", 0.3, 0.1), ("b", 0.1, 0.0)], "feature string, mean double, std double"), 0.7, 0.6)
    assert [tuple(r) for r in plot.orderBy("place").collect()] == [(1, "b", 0.1, 0.0, 0.7, 0.6), (2, "a", 0.3, 0.1, 0.7, 0.6)]


def test_jobs_write_bars(spark, tmp_path):
    from quantloom.plans import jobs

    for name, base in (("x", 100), ("y", 50)):
        (tmp_path / f"{name}.csv").write_text("sip_timestamp,price,size\n" + "".join(f"{1_700_000_000_000_000_000 + k * 1_000_000_000},{base + k % 3},{1 + k % 4}\n" for k in range(40)))
    jobs.one_fund(spark, str(tmp_path / "x.csv"), str(tmp_path / "one"), "x", 800.0)
    jobs.many_funds(spark, {n: str(tmp_path / f"{n}.csv") for n in "xy"}, str(tmp_path / "many"), 800.0)
    one, many = (spark.read.option("header", True).csv(str(tmp_path / d)) for d in ("one", "many"))
    assert one.count() > 5 and many.filter("symbol = 'x'").count() == one.count() and many.filter("symbol = 'y'").count() > 2


def test_stored_orders_are_applied_as_one_by_one(spark):
    from quantloom.operators import fracdiff

    df = spark.createDataFrame([("a", k, float(k % 7), float(k)) for k in range(60)], "symbol string, seq long, p double, q double")
    both = {r.seq: (r.p, r.q) for r in fracdiff.apply_d(df, {"p": 0.3, "q": 0.6}, 0.02).collect()}
    for name, d, at in (("p", 0.3, 0), ("q", 0.6, 1)):
        alone = {r.seq: r.y for r in fracdiff.with_ffd(df, name, d, 0.02, "y").collect()}
        assert all(both[k][at] == alone[k] for k in alone)
    rng = np.random.default_rng(1)
    steps = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(rng.standard_normal(400))], "symbol string, seq long, x double")
    sums = {r.seq: r.x for r in steps.selectExpr("symbol", "seq", "sum(x) over (order by seq) as x").collect()}
    d = fracdiff.least_d(steps.selectExpr("symbol", "seq", "sum(x) over (partition by symbol order by seq) as x"), ["x"], 0.01, 0.05).first().d
    got = {r.seq: r.x for r in fracdiff.stationary_features(steps, ["x"]).collect()}
    w = fracdiff.ffd_weights(d, 0.01) if d else [1.0]
    for k in (50, 399):
        assert got[k] == pytest.approx(sum(a * sums[k - j] for j, a in enumerate(w)), abs=1e-9)


def test_boxes_of_cells_tell_few_that_may_hold_a_nearer_row():
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((4000, 3)), 3)
    tree = learners.Boxes(x[::5], 120)
    cell = tree.cells(x)
    own = np.unique(cell)
    tree.fill(own, *(np.array([f(x[cell == c]) for c in own]) for f in (len, lambda v: v.min(axis=0), lambda v: v.max(axis=0))))
    asks = rng.standard_normal((50, 3))
    d = learners.squares(asks, x)
    kth = np.sort(d, axis=1)[:, 4]
    q, near = tree.near(asks, kth)
    for k in range(50):
        assert set(cell[d[k] <= kth[k]].tolist()) <= set(near[q == k].tolist())
    assert len(q) / 50 < 15 and tree.count[1] == 4000
    node, up = tree.first(asks, 100)
    assert (tree.count[node] >= 100).all()
    row, under = tree.below(node, up)
    assert [tree.count[under[row == k] + tree.leaves].sum() for k in range(50)] == tree.count[node].tolist()


def test_equal_rows_beyond_the_first_are_not_searched(spark, monkeypatch):
    sizes, cut = [], learners.cut
    monkeypatch.setattr(learners, "cut", lambda df: sizes.append(df.count() if "_cell" in df.columns and "symbol" in df.columns else 0) or cut(df))
    x = np.repeat([[0.0, 0.0], [1.0, 2.0], [1.0, 2.5]], [300, 40, 3], axis=0)
    y = (np.arange(343) % 3 == 0).astype(int)
    model = learners.nearest_neighbours(["x0", "x1"], 5)(frame(spark, x, y).repartition(3))
    got = {r.pos: r.score for r in model(frame(spark, np.array([[0.0, 0.0], [1.0, 2.0], [1.0, 2.6], [0.0, 0.0]]), [0] * 4)).collect()}
    order = {k: ("a" if k % 3 else "b", k) for k in range(343)}
    first = lambda rows, n: sorted(rows, key=order.get)[:n]
    want = [first(range(300), 5), first(range(300, 340), 5), [340, 341, 342, *first(range(300, 340), 2)]]
    assert [got[k] for k in (0, 1, 2, 3)] == [pytest.approx(y[want[k]].mean()) for k in (0, 1, 2, 0)]
    assert max(sizes) == 13


def test_distances_that_only_their_roots_make_equal(spark):
    """Two rows whose squared distances differ in the last bit, though their roots do not: the nearer one counts, not the first."""
    rng = np.random.default_rng(5)
    while True:
        near = rng.random(2)
        far = near[::-1] * np.array([1.0, 1 + 2.0**-52])
        a, b = (float(p[0] * p[0] + p[1] * p[1]) for p in (near, far))
        if a < b and np.sqrt(a) == np.sqrt(b):
            break
    rows = [("a", 0, 0, *far.tolist()), ("a", 1, 1, *near.tolist())]
    schema = "symbol string, pos long, label int, x0 double, x1 double"
    model = learners.nearest_neighbours(["x0", "x1"], 1, scale=False)(spark.createDataFrame(rows, schema))
    assert [r.score for r in model(spark.createDataFrame([("a", 2, 0, 0.0, 0.0)], schema)).collect()] == [1.0]


def test_draw_lists_of_several_seeds_are_those_of_each(spark):
    from quantloom.operators.weights import bootstrap_counts

    df = spark.range(60).selectExpr("if(id % 3 = 0, 'a', 'b') as symbol", "id as pos", "id as i0", "id + 2 + id % 5 as i1")
    both = bootstrap_counts(df, [3, 4]).collect()
    for seed in (3, 4):
        one = sorted(map(tuple, bootstrap_counts(df, seed).collect()))
        assert one == sorted((r.symbol, r.pos, r.times) for r in both if r.seed == seed)
        assert sum(x[2] for x in one) == 60


@pytest.mark.parametrize(("size", "beyond"), [(20, 64), (20, 0)])
def test_draws_in_slices_are_those_of_whole_symbols(spark, monkeypatch, size, beyond):
    from quantloom.operators import weights

    df = spark.range(150).selectExpr("if(id % 3 = 0, 'a', 'b') as symbol", "id as pos", "id as i0", "id + id % 4 as i1").cache()
    told = lambda: sorted(map(tuple, weights.bootstrap_counts(df, [3, 4]).collect()))
    want, held = told(), []
    draw = weights._draws_in_slices
    monkeypatch.setattr(weights, "SLICE", size)
    monkeypatch.setattr(weights, "BEYOND", beyond)
    monkeypatch.setattr(weights, "_draws_in_slices", lambda *x: held.extend(map(len, x[3].values())) or draw(*x))
    assert told() == want and max(held) >= 100 // size - 1
    assert sum(r[3] for r in want) == 300


def test_draws_by_clocks_are_as_likely_as_by_the_plain_form():
    from quantloom.operators import weights

    spans, found = np.array([[0, 2], [1, 3], [2, 2], [5, 6]]), ({}, {})
    for seed in range(4000):
        e, _, u = weights.proposals(weights._streams("a", np.arange(4), seed), 30.0)
        sure, may = weights.thinned(spans, e, u)
        assert (sure == may).all()
        for out, drawn in zip(found, (e[sure][:4], weights.sequential_bootstrap(spans, 4, seed)), strict=True):
            key = tuple(np.bincount(drawn, minlength=4))
            out[key] = out.get(key, 0) + 1
    one, other = found
    cells = set(one) | set(other)
    chi = sum((one.get(k, 0) - other.get(k, 0)) ** 2 / (one.get(k, 0) + other.get(k, 0)) for k in cells)
    assert chi < 70  # of 34 degrees of freedom


def test_mapped_rows_lie_in_parts_of_bounded_size(spark, monkeypatch):
    sizes, cut = [], learners.cut
    monkeypatch.setattr(learners, "MAPPED", 32 * 50, raising=False)
    monkeypatch.setattr(learners, "cut", lambda df: sizes.extend(df.rdd.glom().map(len).collect() if "_z" in df.columns else []) or cut(df))
    x = np.random.default_rng(3).standard_normal((400, 2))
    df = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(int)).coalesce(1)
    learners.rbf_svc(["x0", "x1"], 32, rounds=2)(df)
    assert sum(sizes) == 400 and max(sizes) <= 100


def test_fits_of_all_splits_go_side_by_side(spark):
    rng = np.random.default_rng(4)
    rows = frame(spark, rng.standard_normal((120, 2)), np.arange(120) % 2).cache()
    roles = splits.purged_kfold(rows.select("symbol", "pos", F.col("pos").alias("pred"), F.col("pos").alias("eval")), 3)
    met = threading.Barrier(3, timeout=60)  # broken unless three fits are under way at once

    def fit(train):
        met.wait()
        return models.gaussian_bayes(["x0", "x1"])(train)

    got = models.scores(rows, roles, {"NB": fit}, "accuracy").collect()
    alone = [models._score(models.gaussian_bayes(["x0", "x1"])(rows.join(roles.filter(f"split = {k} and role = 'train'"), ["symbol", "pos"]))(rows.join(roles.filter(f"split = {k} and role = 'test'"), ["symbol", "pos"])), "accuracy") for k in range(3)]
    assert [r.split for r in got] == [0, 1, 2] and [r.score for r in got] == pytest.approx(alone)


def test_rows_of_models_are_dealt_evenly(spark):
    from quantloom.plans import queries

    rows, _ = queries._classified(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.4 * sum(sizes) / 4


def test_the_zoo_fits_whole_models(spark, monkeypatch):
    from quantloom.plans import queries

    fits = {}
    monkeypatch.setattr(models, "compare", lambda rows, roles, given, scoring: fits.update(given))
    queries.QUERIES["model_zoo"](spark, "/root/testdata/sf0.001")
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 4))
    train = spark.createDataFrame([(int(v[0] * v[1] + v[2] > rng.normal()), *map(float, v)) for v in x], "label int, r1 double, r5 double, r20 double, size double").cache()
    assert fits["GBT"](train).model.getNumTrees == 100
    assert fits["SVC"](train).model.getMaxIter() == 100
