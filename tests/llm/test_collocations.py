"""Collocations against counting every run of words, and the cases that they have to bear."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import collocations
from quantloom.llm.substrings import _Ranges
from tests.llm.test_operators import SCHEMA, odd_rows


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def runs(rows, depth=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for p in pieces(text):
            n[lang or "und" if lang != "" else ""] += len(p)
            for size in range(1, depth + 1):
                for i in range(len(p) - size + 1):
                    f[lang if lang is not None else "und", tuple(p[i : i + size])] += 1
    return f, n


def expected(rows, least, top=2000, depth=4, cover=80):
    f, n = runs(rows, depth)
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    by = {}
    for (lang, p), a in c.items():
        if any(100 * b >= cover * a for (m, q), b in c.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in by.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "delta", "é", "Ü", "naïve", "x" * 40, "a-b", "'t"]
    rows = []
    for k in range(160):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append(rng.choice(["new york city", "New York", "in spite of that", "alpha Beta gamma delta", *vocabulary]))
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "; ", "\x0b", "?!", "\r\n", " "]))
        rows.append((("en", "de", None, "und", "")[k % 5], "".join(parts)))
    return [*rows, ("en", None), ("en", ""), (None, " \t . "), ("en", "la la la la la la la la la la la la"), ("en", "one")] + [("fr", "même chose ici encore")] * 7


@pytest.mark.parametrize(("least", "shard", "parts"), [(5, 4 << 20, 1), (5, 600, 3), (2, 100, 5), (30, 1000, 4)])
def test_phrases_against_every_run(spark, least, shard, parts):
    rows = texts()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    df = df.select("*", *(F.lit("mine").alias(c) for c in ("shard", "n", "words", "phrase", "a", "size", "f")))
    got = collocations.collocations(df, least=least, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, least)


def test_best_of_each_language_and_other_bounds(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(df, depth=3, least=3, top=4, cover=50, shard=500).collect()) == expected(rows, 3, 4, 3, 50)


def test_counts_over_many_shards(spark):
    """More than any bound on what one shard sends."""
    rows = [("en", "up and down. " * 90)] * 12 + [("en", "down up, and")] * 3
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert sorted(tuple(r) for r in collocations.collocations(df, least=1000, shard=1000).collect()) == expected(rows, 1000)


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(df, least=2).collect()) == expected([(r[2], r[1]) for r in rows], 2)
    for some in ([], [("en", None)], [(None, "word")], [("en", "a b"), (None, "")]):
        assert collocations.collocations(spark.createDataFrame(some, "lang string, text string"), least=2).collect() == []


def test_states_are_classes_of_end_places():
    """Every substring is in one state, the suffixes of a state's longest one down to its shortest end where it ends, and no others do."""
    rng = random.Random(3)
    text = " ".join(rng.choice("abc") for _ in range(300)).encode() + b". " + b"d e f g. d e f g. e f g"
    with np.errstate(over="ignore"):
        words, ids, first = collocations.tokenized(text)
        a = collocations.Automaton(b" ".join(words), ids, first, "en")
        alive = [np.ones(len(words), dtype=bool)]
        for _ in range(3):
            a.keep(alive[-1])
            a.grow()
            alive.append(np.ones(len(a.counts[-1]), dtype=bool))
    f, _ = runs([("en", text.decode())])
    got = {}
    for longest, shortest, n in a.states(alive):
        w = tuple(longest.decode().split(" "))
        assert shortest <= len(w)
        for size in range(shortest, len(w) + 1):
            assert w[-size:] not in got
            got[w[-size:]] = n
        if shortest > 1:
            assert f["en", w[1 - shortest :]] > n
    assert got == {k[1]: v for k, v in f.items()}
    assert any(longest == b"d e f g" and shortest == 1 or shortest < len(longest.split()) for longest, shortest, _ in a.states(alive))


@pytest.mark.parametrize("least", [200, 300])
def test_names_come_back_with_their_bits(least):
    rng = np.random.default_rng(1)
    ranges = _Ranges(7, np.uint32)
    names = [np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)), np.zeros(0, dtype=np.uint64)]
    names.append(np.unique(np.concatenate([names[0][:50], rng.integers(0, 1 << 63, 90).astype(np.uint64)])))
    counts = [rng.integers(1, 400, len(x)) for x in names]
    import pyarrow as pa

    sent = sorted((place, k, a, b) for k, (x, c) in enumerate(zip(names, counts, strict=True)) for place, a, b in collocations._sent(ranges, x, c, collocations._kind(least)))
    columns = [pa.array(c, t) for c, t in zip(zip(*sent, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
    out = list(collocations._frequent(least)([pa.RecordBatch.from_arrays(columns, ["place", "shard", "names", "counts"])]))
    bits = {(r["shard"], r["place"]): r["bits"] for b in out for r in b.to_pylist()}
    total = Counter()
    for x, c in zip(names, counts, strict=True):
        for name, n in zip(x.tolist(), c.tolist(), strict=True):
            total[name] += n
    for k, x in enumerate(names):
        hits = collocations._hits(ranges, x, {p: b for (s, p), b in bits.items() if s == k})
        assert hits.tolist() == [total[v] >= least for v in x.tolist()]
