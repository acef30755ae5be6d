"""Personal data: base patterns, and a skip-chain conditional random field over what they leave open.

The nodes of a document's field are its base spans, whose labels are known, and its other number-like and address-like spans.
Neighbours in the text share a chain potential; distant spans with the same digits, or the same local part of an address, share a
skip potential: each with a base span of the thing if there is one, however far, and else with its next such span, so that a span
repeated n times has n-1 links. Belief propagation, in sweeps forward and backward along each run of neighbours and each chain of
repeats until nothing changes, then makes the labels of one thing agree across the document: a number that stands once as
``+1 (017) 555-7713`` is found again as ``1 017 555 7713``. All weights have the greatest pseudo-likelihood on a bounded sample of documents,
whose base spans are the labels; each of them also stands for a repeat that is written otherwise, and whose label the base patterns do not give.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Documents from which the weights are fitted: those with digits or @ that come first by a hash of their id.
SAMPLE = 500
#: Messages are passed until no belief changes by SETTLED; a field whose loops never settle stops after MOST_ROUNDS sweeps over all of it.
SETTLED, MOST_ROUNDS, SURE = 1e-6, 1000, 0.9
#: Gradient steps of the fit, and the penalty on squared weights.
FIT_STEPS, PENALTY = 3000, 1e-4

Span = tuple[int, int, int]  # kind, start, end

_GATE = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])+")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """The pattern's leftmost matches, in time linear in the text: a match's local part is what stands before its @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind and start; ends are exclusive, in code points."""
    if not _GATE.search(text):
        return []
    out = emails(text)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal data and overlap no base span; their kind is NONE."""
    taken = sorted((s, e) for _, s, e in base)
    out: list[Span] = []
    for m in [*_NUMBER.finditer(text), *(_ADDRESS.finditer(text) if "@" in text or "at]" in text or "at)" in text else ())]:
        if m.end() - m.start() >= 7:
            out.append((NONE, m.start(), m.end()))
    out.sort(key=lambda x: (x[1], -x[2]))
    kept, k, free = [], 0, 0
    for kind, s, e in out:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= free and not (k < len(taken) and taken[k][0] < e):
            kept.append((kind, s, e))
            free = e
    return kept


def key_of(text: str, span: Span) -> str | None:
    """What spans of the same thing have in common: the last ten digits, or the local part."""
    piece = text[span[1] : span[2]]
    if re.search("[A-Za-z]", piece):
        return "a" + re.split(r"@|\x20?[\[(]at[\])]", piece)[0].lower()
    digits = re.sub("[^0-9]", "", piece)
    return "d" + digits[-10:] if len(digits) >= 7 else None


#: Indicator features of a span.
FEATURES = 26


def features(text: str, span: Span) -> list[int]:
    s, e = span[1], span[2]
    piece = text[s:e]
    digits = sum(c.isdigit() for c in piece)
    letters = sum(c.isalpha() for c in piece)
    out = [0, 1 + min(digits, 19) // 2]  # 1..10
    out += [11] if "@" in piece else []
    out += [12 + min(piece.count("."), 3)]  # 12..15
    out += [16] if letters else [17]
    out += [18] if "(" in piece else []
    out += [19] if "-" in piece else []
    out += [20] if " " in piece else []
    out += [21] if s and text[s - 1] in "+(" or piece[0] == "+" else []
    out += [22] if s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum() else []
    out += [23] if s and text[s - 1] in "\"'=:#" or e < len(text) and text[e] in "\"'" else []
    out += [24] if digits and 13 <= digits <= 19 and luhn(re.sub("[^0-9]", "", piece)) else []
    out += [25] if re.search(r"(?i)tel|phone|call|mail|card|iban", text[max(0, s - 24) : s]) else []
    return out


@dataclass
class Model:
    unary: np.ndarray  # (labels, FEATURES)
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray


def written_otherwise(piece: str, kind: int) -> str:
    """A base span's thing in a form that no base pattern finds."""
    if kind == 0:
        local, _, domain = piece.partition("@")
        return f"{local} [at] {domain.replace('.', ' [dot] ')}"
    digits = re.sub("[^0-9]", "", piece)
    if kind == 1:
        return piece.replace(".", " . ")
    step = 3 if kind == 3 else 4
    groups = [digits[k : k + step] for k in range(0, len(digits), step)]
    return (" " if kind == 3 else ".").join(groups)


def evidence(text: str) -> Iterator[tuple[list[int], int, int, int, int]]:
    """What a text says of the weights: (features, label, label of the neighbour before, after, of a span of the same thing; -1: none).

    Base spans have their kinds. Each also stands for a repeat of its thing that is written otherwise, in its place and with the span itself as
    its like: so the field learns from labels that it could not see. Other candidates have no kind, but those that
    repeat a base span's thing: of these nothing is known, and nothing is learned.
    """
    base = base_spans(text)
    nodes = sorted([*base, *candidates(text, base)], key=lambda n: n[1])
    keys = [key_of(text, n) for n in nodes]
    of = {k: n[0] for n, k in zip(nodes, keys, strict=True) if n[0] != NONE and k is not None}
    unknown = [n[0] == NONE and k in of for n, k in zip(nodes, keys, strict=True)]
    close = lambda i, j: 0 <= i and j < len(nodes) and nodes[j][1] - nodes[i][2] <= 80 and not unknown[i] and not unknown[j]
    seen: dict[str, int] = {}
    for k, n in enumerate(nodes):
        if unknown[k]:
            continue
        before, after = nodes[k - 1][0] if close(k - 1, k) else -1, nodes[k + 1][0] if close(k, k + 1) else -1
        yield features(text, n), n[0], before, after, seen.get(keys[k] or "", -1)
        if keys[k] is not None:
            seen[keys[k]] = n[0]
        if n[0] != NONE:
            other = written_otherwise(text[n[1] : n[2]], n[0])
            around = text[max(0, n[1] - 24) : n[1]]
            yield features(around + other + text[n[2] : n[2] + 1], (n[0], len(around), len(around) + len(other))), n[0], before, after, n[0]


def fit(texts: list[str]) -> Model:
    """As ``fit_counts``, of texts at hand."""
    counts = Counter((tuple(f), *labels) for text in texts for f, *labels in evidence(text))
    return fit_counts([(*k, n) for k, n in counts.items()])


def fit_counts(rows: list[tuple[tuple[int, ...], int, int, int, int, int]]) -> Model:
    """The weights of the greatest pseudo-likelihood: each node's label given its features and its neighbours' labels, with a penalty
    on the weights' squares; ``rows`` are evidence with how often it occurs."""
    labels = NONE + 1
    w, chain, skip = np.zeros((labels, FEATURES)), np.zeros((labels, labels)), np.zeros((labels, labels))
    w[NONE, 0] = 2.0
    rows = sorted((tuple(r[0]), *r[1:]) for r in rows)
    if rows:
        data = np.zeros((len(rows), FEATURES))
        for k, r in enumerate(rows):
            data[k, list(r[0])] = 1
        of = lambda c: np.array([[r[c] == x for x in range(labels)] for r in rows], dtype=float)
        target, before, after, like = of(1), of(2), of(3), of(4)
        weight = np.array([r[5] for r in rows], dtype=float)
        weight = (weight / weight.sum())[:, None]
        for _ in range(FIT_STEPS):
            z = data @ w.T + before @ chain + after @ chain.T + like @ skip
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (target - p) * weight
            w += g.T @ data - PENALTY * w
            chain += before.T @ g + g.T @ after - PENALTY * chain
            pull = like.T @ g
            skip += (pull + pull.T) / 2 - PENALTY * skip
    return Model(w, chain, skip)


def chain_runs(links: list[tuple[int, int]]) -> list[list[int]]:
    """The nodes of ``links``, each of which has at most one link from it and one to it, chain by chain."""
    follows, inner = dict(links), {b for _, b in links}
    out = []
    for a in sorted(follows.keys() - inner):
        run = [a]
        while run[-1] in follows:
            run.append(follows[run[-1]])
        out.append(run)
    return out


def sent(source: np.ndarray, pot: np.ndarray) -> np.ndarray:
    m = source[:, None] + pot
    top = m.max(axis=0)
    out = top + np.log(np.exp(m - top).sum(axis=0))
    return out - out.max()


def sweep(belief: np.ndarray, run: list[int], pot: np.ndarray, held: dict[tuple[int, int], np.ndarray], keep: float) -> None:
    """Messages forward and then backward along one chain, exact on it given what its nodes get from elsewhere; ``belief`` follows."""
    none = np.zeros(belief.shape[1])
    for nodes, p in ((run, pot), (run[::-1], pot.T)):
        for a, b in zip(nodes, nodes[1:], strict=False):
            old = held.get((a, b), none)
            new = keep * old + (1 - keep) * sent(belief[a] - held.get((b, a), none), p)
            belief[b] += new - old
            held[a, b] = new


Links = list[tuple[int, int]]


def field(text: str, base: list[Span], model: Model) -> tuple[list[Span], np.ndarray, Links, Links, Links]:
    """(nodes, what each is by itself, chain links, skip links between open ones, skip links from known ones to open ones)."""
    nodes = sorted([*base, *candidates(text, base)], key=lambda n: n[1])
    labels = NONE + 1
    unary = np.empty((len(nodes), labels))
    for k, n in enumerate(nodes):
        if n[0] != NONE:
            unary[k] = -30.0
            unary[k, n[0]] = 0.0
        else:
            u = model.unary[:, features(text, n)].sum(axis=1)
            unary[k] = u - u.max()
    links = [(k - 1, k) for k in range(1, len(nodes)) if nodes[k][1] - nodes[k - 1][2] <= 80]
    groups: dict[str, list[int]] = {}
    for k, n in enumerate(nodes):
        if (key := key_of(text, n)) is not None:
            groups.setdefault(key, []).append(k)
    skips: Links = []
    told_: Links = []
    for g in groups.values():
        known = [k for k in g if nodes[k][0] != NONE]
        if not known:
            skips += zip(g, g[1:], strict=False)
            continue
        # what is known of a thing reaches each of its repeats directly: from the known span before, or else the first one
        now = known[0]
        for k in g:
            if nodes[k][0] != NONE:
                now = k
            else:
                told_.append((now, k))
    return nodes, unary, links, skips, told_


def beliefs(unary: np.ndarray, links: Links, skips: Links, told_: Links, model: Model) -> np.ndarray:
    """The nodes' label probabilities by sweeps over the chains of ``links`` and ``skips`` until nothing changes."""
    belief = unary.copy()
    for known, k in told_:
        belief[k] += sent(unary[known], model.skip)
    # messages into the two ends of each link, by kind of link
    kinds = [(chain_runs(links), model.chain, {}), (chain_runs(skips), model.skip, {})]
    last = None
    for step in range(MOST_ROUNDS):
        # damped once it does not settle of itself
        keep = 0.0 if step < 20 else 0.5
        for runs, pot, held in kinds:
            for run in runs:
                sweep(belief, run, pot, held, keep)
        if last is not None and np.abs(belief - last).max() < SETTLED:
            break
        last = belief.copy()
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def infer(text: str, base: list[Span], model: Model) -> list[Span]:
    """Spans that the field adds: sure of their label, overlapping no base span."""
    nodes, *rest = field(text, base, model)
    if len(nodes) == len(base):
        return []
    out = []
    for n, p in zip(nodes, beliefs(*rest, model), strict=True):
        best = int(p.argmax())
        if n[0] == NONE and best != NONE and p[best] >= SURE:
            out.append((best, n[1], n[2]))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


COUNTED = "features array<int>, label int, before int, after int, same int, n long"


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            counts = Counter((tuple(f), *labels) for f, *labels in evidence(text.as_py()))
            rows = [(*k, n) for k, n in counts.items()]
            kinds = [pa.list_(pa.int32()), *[pa.int32()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in COUNTED.split(", ")])


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the whole texts of at most ``sample`` documents; the same rows give the same model.

    The documents are chosen by a hash, of which alone the driver sees the least; their evidence is gathered where the texts are, and
    the driver gets its counts.
    """
    rows = docs.select(F.col(text).alias("t"), F.xxhash64(key, text).alias("h"))
    rows = rows.filter(F.col("t").rlike("[0-9@]"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return fit_counts([])
    found = rows.filter(F.col("h") <= last).select("t").mapInArrow(_evidence, COUNTED)
    return fit_counts([tuple(r) for r in found.groupBy("features", "label", "before", "after", "same").agg(F.sum("n").alias("n")).collect()])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span's kind in its stead; of overlapping spans the union takes the first one's kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def find_private(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``docs`` with counts of base spans by kind, base_sha256, all spans and redacted, in the stead of columns of those names.

    A null text is an empty one, without spans; its redacted text is empty. Rows are independent of each other but for the model, so
    repeated rows get the same answer.
    """
    from .pieces import _added

    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text, key))

    def function(texts: list[str | None]) -> list[pa.Array]:
        rows = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            spans = base + infer(t, base, shared.value) if base or _GATE.search(t) else []
            n = [sum(k == kind for k, *_ in base) for kind in range(NONE)]
            rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), redact(t, spans) if spans else t))
        return [pa.array(c, pa.int64() if k < NONE else pa.string()) for k, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64() if k < NONE else pa.string()) for k in range(7)]

    return _added(docs, FOUND, text, function)
