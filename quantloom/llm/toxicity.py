"""Toxicity: a chain of linear classifiers, each fed the probabilities of the categories before it.

The models are fitted on a bounded sample of labelled documents. A later model is trained with out-of-fold probabilities of the
earlier categories, so that it meets in training what it will meet in scoring. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are fitted on: those that come first by a hash of their id.
SAMPLE = 4000
FOLDS, STEPS, RATE, RIDGE = 5, 300, 0.3, 5e-5
#: Documents of the sample that a word must be in to be a feature, and how many deviations its documents' share of some category
#: must be from the sample's.
LEAST_IN, LEAST_Z = 5, 4.0

#: Lengths of the stems that stand for all forms of a word.
STEMS = (5, 7)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """A text's distinct words in lower case with their stems, and marks, which no word is like, of how varied they are and how much else there is."""
    found = _WORD.findall(text.lower())
    each = set(found)
    for n in STEMS:
        each |= {w[:n] + "~" for w in each if len(w) > n}
    if found:
        each |= {f"#varied{8 * len(each) // len(found)}", f"#letters{16 * sum(map(len, found)) // len(text)}", f"#size{len(found).bit_length()}"}
    return each


@dataclass
class Chain:
    """weights: word -> one weight a category; links: (categories, categories), of the earlier probabilities' log odds."""

    categories: list[str]
    weights: dict[str, tuple[float, ...]]
    links: np.ndarray
    bias: np.ndarray

    def score(self, found: set[str]) -> list[float]:
        base = [0.0] * len(self.categories)
        get = self.weights.get
        for w in map(get, found):
            if w is not None:
                for k, x in enumerate(w):
                    base[k] += x
        out: list[float] = []
        odds: list[float] = []
        for k, x in enumerate(base):
            z = x + self.bias[k] + sum(o * self.links[k, j] for j, o in enumerate(odds))
            p = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
            out.append(float(p))
            odds.append(_odds(p))
        return out


def _odds(p):
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, extra: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple:
    """Weights of m indicator features, of the columns of ``extra`` and a bias, over the rows in ``use``, by gradient steps scaled as in Adagrad."""
    w, v, b = np.zeros(m), np.zeros(extra.shape[1]), np.zeros(1)
    gw, gv, gb = np.full(m, 1e-8), np.full(extra.shape[1], 1e-8), np.full(1, 1e-8)
    weight = use / max(1, use.sum())
    for _ in range(STEPS):
        z = np.bincount(rows, w[cols], n) + extra @ v + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        for x, s, d in ((w, gw, np.bincount(cols, g[rows], m) + RIDGE * w), (v, gv, extra.T @ g + RIDGE * v), (b, gb, np.array([g.sum()]))):
            s += d * d
            x -= RATE * d / np.sqrt(s)
    return w, v, float(b[0])


def fit(found: list[list[str]], labels: np.ndarray, categories: list[str]) -> Chain:
    """found: each document's distinct words; labels: (documents, categories) of 0 and 1."""
    counts = Counter(w for ws in found for w in ws)
    share = labels.mean(axis=0) if len(found) else np.zeros(len(categories))
    hits = {w: np.zeros(len(categories)) for w, n in counts.items() if n >= LEAST_IN}
    for ws, y in zip(found, labels, strict=True):
        if y.any():
            for w in ws:
                if w in hits:
                    hits[w] += y
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    names = sorted(w for w, h in hits.items() if (np.abs(h - counts[w] * share) >= LEAST_Z * spread * counts[w] ** 0.5).any())
    ids = {w: k for k, w in enumerate(names)}
    pairs = [(r, ids[w]) for r, ws in enumerate(found) for w in ws if w in ids]
    rows, cols = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    n, m, k = len(found), len(names), len(categories)
    fold = np.arange(n) % FOLDS
    weights, links, bias = np.zeros((m, k)), np.zeros((k, k)), np.zeros(k)
    held = np.zeros((n, 0))
    for c in range(k):
        y = labels[:, c].astype(float)
        w, v, b = _logistic(rows, cols, n, m, held, y, np.ones(n)) if n else (np.zeros(m), np.zeros(c), 0.0)
        weights[:, c], links[c, :c], bias[c] = w, v, b
        if c + 1 < k:
            p = np.zeros(n)
            for f in range(FOLDS):
                w, v, b = _logistic(rows, cols, n, m, held, y, (fold != f).astype(float))
                z = np.bincount(rows, w[cols], n) + held @ v + b
                p[fold == f] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[fold == f]
            held = np.column_stack([held, _odds(p)])
    return Chain(categories, dict(zip(names, map(tuple, weights.tolist()), strict=True)), links, bias)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> Chain:
    """Fit on at most ``sample`` documents of ``labels`` (doc_id and a 0/1 column a category) with their whole texts.

    Rows of ``labels`` with a null are left out; where rows of one doc_id differ, a category that any of them has holds, in any order.
    """
    known = labels.select("doc_id", *(F.col(c).cast("int").alias(c) for c in categories)).dropna()
    known = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), *batch.columns[2:]], ["doc_id", "found", *categories])

    got = rows.select("doc_id", "text", *categories).mapInArrow(run, "doc_id long, found array<string>, " + ", ".join(f"`{c}` int" for c in categories))
    got = sorted(got.collect(), key=lambda r: (r.doc_id, r.found))[:sample]
    return fit([r.found for r in got], np.array([[r[c] for c in categories] for r in got]).reshape(len(got), len(categories)), categories)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``docs`` with p_<category> for each of ``categories``, in the order of the chain, and toxic: whether the last one reaches ``threshold``.

    A null or empty text has no words, and the probabilities that the biases give. Without labelled documents every probability is
    0.5 and toxic is false for a threshold above that. Rows are scored one by one, so repeated rows agree.
    """
    from .pieces import _added

    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, sample))
    names = [f"p_{c}" for c in categories]

    def function(texts: list[str | None]) -> list[pa.Array]:
        p = [shared.value.score(words(t or "")) for t in texts]
        return [*(pa.array([x[k] for x in p], pa.float64()) for k in range(len(names))), pa.array([x[-1] >= threshold for x in p], pa.bool_())]

    return _added(docs, ", ".join([*(f"{c} double" for c in names), "toxic boolean"]), "text", function)
