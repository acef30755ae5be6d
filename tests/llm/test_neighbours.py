"""Nearest neighbours against brute force, and the cases that they have to bear."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import neighbours

DATA = "/root/testdata/sf0.1"


def brute(rows, k=5, every=50):
    """{query: [(vec_id, score)]} of (vec_id, vector) without nulls."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0).tolist():
        s = neighbours.cosines(np.repeat(x[q : q + 1], len(x), axis=0), x)
        order = [j for j in np.lexsort((ids, -s)).tolist() if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df, **more):
    out = {}
    for r in sorted(neighbours.neighbours(df, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([sum(s >= want[q][-1][1] - 1e-12 for _, s in got[q]) / len(want[q]) for q in want])


def mixed(n, dim, seed):
    """Tight clusters, loose ones, and scattered vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 40, dim))
    spread = np.where(np.arange(n) % 3 == 0, 0.05, np.where(np.arange(n) % 3 == 1, 0.6, 30.0))
    return centres[rng.integers(0, len(centres), n)] + spread[:, None] * rng.standard_normal((n, dim))


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = found(df), brute(rows)
    assert recall(got, want) >= 0.9
    exact = {q: dict(brute([r for r in rows if r[0] == q or r[0] in dict(got[q])])[q]) for q in list(got)[:20]}
    assert all(dict(got[q]) == exact[q] for q in exact)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_over_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "SAMPLE", 1500)
    x = mixed(6000, 24, 4)
    x = x.astype(np.float32) if kind == "float" else x
    rows = [(3 * k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    assert recall(found(df), brute(rows)) >= 0.95


def test_a_common_vector_and_ties(spark):
    """A third of all rows are one vector: the smallest ids of it are the answer, and other rows are found as before."""
    x = mixed(1500, 16, 6).astype(np.float32)
    rows = [(k, (x[7] if k % 3 == 0 else x[k]).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got, want = found(df), brute(rows)
    assert recall(got, want) >= 0.95
    for q in range(0, 1500, 150):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] == [i for i in (0, 3, 6, 7, 9, 12) if i != q][:5]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (50, [0.0, 1e-30]), (-50, [-2.0, 1.0]), (7, [3.0, 4.0]), (8, [6.0, 8.0]), (9, [1e30, 1e30])]
    bad = [(None, [1.0, 1.0]), (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 0.0]), (300, [None, 1.0]), (350, []), (400, [1.0, 2.0, 3.0]), (450, [1.0])]
    df = spark.createDataFrame([*good, *bad, *good[:3], (0, [9.0, 9.0])], "vec_id long, embedding array<float>").repartition(4)
    df = df.select("*", *(F.lit("mine").alias(c) for c in ("id", "x", "n", "block", "rank", "score")))
    got = found(df)
    want = brute([(i, np.array(v, dtype=np.float32)) for i, v in good])
    assert got == want and len(got[0]) == 5


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(spark.createDataFrame([], schema)) == found(spark.createDataFrame([(0, None)], schema)) == found(spark.createDataFrame([(0, [1.0])], schema)) == {}
    assert found(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)) == {}
    rows = [(k, [math.cos(k), math.sin(k)]) for k in range(0, 200, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, every=20, k=12) == brute(rows, 12, 20)
    assert found(df.unionAll(df), every=20, k=3) == brute(rows, 3, 20)


def test_the_queue_takes_the_best_leaves_of_all_trees():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 12))
    forest = neighbours.fit(x, 100_000, 2)
    u = neighbours.unit(x[:20])
    sizes = [np.bincount(forest.leaves(neighbours.unit(x), t), minlength=1 << forest.depth).tolist() for t in range(2)]
    for q in range(20):
        margins = [(forest.directions[t] @ u[q] - forest.thresholds[t]).tolist() for t in range(2)]
        least = []
        for t in range(2):
            for leaf in range(1 << forest.depth):
                node, m = leaf + (1 << forest.depth), math.inf
                while node > 1:
                    m = min(m, margins[t][node // 2] if node % 2 else -margins[t][node // 2])
                    node //= 2
                least.append((m, t, leaf))
        for bound in (-0.05, -0.3):
            taken = forest.search(margins, bound, sizes)
            want = {(t, leaf) for m, t, leaf in least if m >= bound}
            got = {(t, leaf) for t in range(2) for leaf in taken[t]}
            assert want <= got and (want == got or sum(sizes[t][leaf] for t, leaf in want) < neighbours.LEAST)
            assert forest.leaves(u[q : q + 1], 0)[0] in taken[0]
