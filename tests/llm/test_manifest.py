"""The manifest against a plain tree, and the cases that it has to bear."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantloom.llm import manifest
from tests.llm.test_operators import SCHEMA, odd_rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests, fanout):
    """(root, for each leaf [(before, after) a level])."""
    paths, at, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        runs = [now[k : k + fanout] for k in range(0, len(now), fanout)]
        for path, i in zip(paths, at, strict=True):
            run, place = runs[i // fanout], i % fanout
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        now, at = [h(*run) for run in runs], [i // fanout for i in at]
    return now[0], paths


def expected(rows, fanout=2):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for i, text, lang, source, n in rows:
        leaf = h(enc(i), enc(source), enc(lang), enc(n), enc(text))
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        wrong = h(enc(i), enc(source), enc(lang), enc(n + 1 if n is not None else None), enc(text)) if hit else leaf
        by.setdefault(lang, []).append(((i is not None, i or 0), leaf, wrong, i))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda x: x[:2])
        trees.append(tree([x[1] for x in by[lang]], fanout))
    root, tops = tree([t[0] for t in trees], fanout) if trees else (None, [])
    out = Counter()
    for lang, (sub, paths), top in zip(langs, trees, tops, strict=True):
        for (_, leaf, wrong, i), path in zip(by[lang], paths, strict=True):
            folded = wrong
            for before, after in (*path, *top):
                folded = h(before, folded, after)
            out[(i, leaf, sub, root, h(*(b + a for b, a in (*path, *top))), folded, folded == root)] += 1
    return out


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest_of_odd_rows(spark, fanout):
    rows = [(*r[:4], None if k % 5 == 0 else k, *r[5:]) for k, r in enumerate(odd_rows())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *(F.lit("mine").alias(c) for c in ("group", "idx", "n", "digest", "leaf", "at")))
    assert Counter(tuple(r) for r in manifest.manifest(df, fanout).collect()) == expected([r[:5] for r in rows], fanout)


def test_groups_of_many_sizes_over_stages(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 4)
    rows = [(k * 7919 % 1009, f"text {k}", None if k < 40 else "" if k < 41 else "en" if k < 240 else f"l{k}", f"s{k % 3}", k) for k in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = manifest.manifest(df).collect()
    assert Counter(tuple(r) for r in got) == expected(rows)
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_small_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert manifest.manifest(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(1, None, None, None, None)], [(1, "x" * 300_000, "en", "s", 5)], [(5, "é", "en", "s", 1)] * 3):
        assert Counter(tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, schema)).collect()) == expected(rows)
