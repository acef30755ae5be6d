"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position it gives, along its output links, every piece that
ends there; each relaxes the best score of the position by the score of where it starts (Viterbi). A character that no piece
reaches is spelled in byte pieces, or is <unk> for a model without them.

A text is cut where no piece can cross: before a word's space sign, if pieces have it only in front, and around line ends, if they
are in no piece. The best segmentation of the whole is that of its parts, so parts are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SPACE = "▁"
#: Parts kept by each worker, half of them met since the other half was full.
KEPT = 160_000
#: Parts that are segmented together.
AT_ONCE = 4096
#: Parts that are looked up together.
TOGETHER = 50_000
#: How much worse than the worst piece an unknown character is, as in the published library.
UNKNOWN = 10.0

ENCODED = "ids binary, n_pieces long"


@dataclass
class Vocabulary:
    """Pieces by id with their scores; of kinds N(ormal), B(yte), U(nknown), C(ontrol)."""

    pieces: list[str]
    scores: list[float]
    kinds: str
    prefix: bool = True
    key: str = field(default="")

    def __post_init__(self) -> None:
        self.key = hashlib.sha256(repr((self.pieces, self.scores, self.kinds, self.prefix)).encode()).hexdigest()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model_file: str) -> Vocabulary:
    """The vocabulary of a model file, read on the driver. Its normaliser has to be the identity but for the space sign."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = range(m.vocab_size())
    kinds = "".join("B" if m.is_byte(i) else "U" if m.is_unknown(i) else "C" if m.is_control(i) or m.is_unused(i) else "N" for i in n)
    probe = "  Ａ a  b\n\tﬁ é "
    marked = m.normalize(probe).replace(" ", SPACE)
    plain = probe.replace(" ", SPACE)
    if marked not in (plain, SPACE + plain):
        raise ValueError("the model's normaliser changes texts")
    prefix = m.decode(m.encode("a")) == "a" and m.encode("a", out_type=str)[0].startswith(SPACE)
    return Vocabulary([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], kinds, prefix)


class Codec:
    def __init__(self, v: Vocabulary) -> None:
        import ahocorasick

        self.prefix = v.prefix
        normal = [i for i, k in enumerate(v.kinds) if k == "N"]
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            if v.pieces[i]:
                self.automaton.add_word(v.pieces[i], i)
        self.automaton.make_automaton()
        self.singles = {v.pieces[i] for i in normal if len(v.pieces[i]) == 1}
        self.unknown_score = min((v.scores[i] for i in normal), default=0.0) - UNKNOWN
        self.unknown = v.kinds.find("U")
        self.byte = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == "B"}
        #: What each id decodes to.
        self.surface = [b"" if k == "C" else bytes([int(p[3:5], 16)]) if k == "B" else " ⁇ ".encode() if k == "U" else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        inside = any(SPACE in v.pieces[i].lstrip(SPACE) for i in normal)
        line = any("\n" in v.pieces[i] and len(v.pieces[i]) > 1 for i in normal)
        self.parts = re.compile(
            "(?s:.+)" if inside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if line else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+"
        )

        #: A character of no piece, to stand between parts.
        self.between = next(c for c in map(chr, range(1, 0x110000)) if not any(c in v.pieces[i] for i in normal))
        self.sizes = np.array([len(p) for p in v.pieces], dtype=np.int64)
        self.scores = np.array(v.scores)
        self.of = list(zip(self.sizes.tolist(), v.scores, strict=True))
        #: Parts met of late, and those met before them: what is met again moves over, the rest goes when the first table is full.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def spelled(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def segment(self, part: str) -> bytes:
        """Viterbi over one part; ids as little-endian int32. Of equal scores the longer last piece wins."""
        n = len(part)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0
        unknown, singles = self.unknown_score, self.singles

        def settle(upto: int) -> None:
            """Positions past which no piece can end any more: their last character, if it is no piece, may be spelled."""
            for e in range(done + 1, upto + 1):
                if part[e - 1] not in singles:
                    s = best[e - 1] + unknown
                    if best[e] is None or s > best[e]:
                        best[e], came[e] = s, (e - 1, -1)

        for last, i in self.automaton.iter(part):
            size, score = self.of[i]
            end = last + 1
            if last > done:
                settle(last)
                done = last
            start = end - size
            s = best[start] + score
            if best[end] is None or s > best[end]:
                best[end], came[end] = s, (start, i)
        settle(n)
        out, at = [], n
        while at:
            start, i = came[at]
            out.append([i] if i >= 0 else self.spelled(part[start:at]))
            at = start
        return np.array([i for ids in reversed(out) for i in ids], dtype="<i4").tobytes()

    def segment_all(self, parts: list[str]) -> list[bytes]:
        """``segment`` of many short parts at once: position by position, every part's matches that end there relax together."""
        size = np.array([len(p) for p in parts])
        top = int(size.max())
        begin = np.cumsum(size + 1) - size - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(self.between.join(parts))), np.int64).reshape(-1, 2)
        last, ids = found[:, 0], found[:, 1]
        word = np.repeat(np.arange(len(parts)), size + 1)[last]
        end = last - begin[word] + 1
        length = self.sizes[ids]
        single = np.zeros(int(begin[-1] + size[-1]) + 1, dtype=bool)
        single[last[length == 1]] = True
        single[(begin + size)[:-1]] = True
        whole = np.logical_and.reduceat(single[:-1], begin)
        best = np.zeros((len(parts), top + 1))
        came, piece = np.zeros((len(parts), top + 1), dtype=np.int64), np.zeros((len(parts), top + 1), dtype=np.int64)
        order = np.argsort(end, kind="stable")
        bounds = np.searchsorted(end[order], np.arange(1, top + 2))
        for e in range(1, top + 1):
            at = order[bounds[e - 1] : bounds[e]]
            at = at[whole[word[at]]]
            if not len(at):
                continue
            w, start = word[at], e - length[at]
            score = best[w, start] + self.scores[ids[at]]
            group = np.flatnonzero(np.diff(w, prepend=-1))
            most = np.repeat(np.maximum.reduceat(score, group), np.diff(np.append(group, len(w))))
            hit = np.flatnonzero(score == most)
            hit = hit[np.diff(w[hit], prepend=-1) != 0]  # of equal scores the longest piece, which comes first
            best[w[hit], e], came[w[hit], e], piece[w[hit], e] = score[hit], start[hit], ids[at[hit]]
        out: list[bytes] = [b""] * len(parts)
        live = np.flatnonzero(whole)
        now = size[live]
        rows, steps = [], []
        while len(live):
            rows.append(live)
            steps.append(piece[live, now])
            now = came[live, now]
            live, now = live[now > 0], now[now > 0]
        if rows:
            row, got = np.concatenate(rows[::-1]), np.concatenate(steps[::-1]).astype("<i4")
            by = np.argsort(row, kind="stable")
            row, got = row[by], got[by]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            told = got.tobytes()
            for w, a, b in zip(row[first].tolist(), (4 * first).tolist(), [*(4 * first[1:]).tolist(), len(told)], strict=True):
                out[w] = told[a:b]
        for w in np.flatnonzero(~whole).tolist():
            out[w] = self.segment(parts[w])
        return out

    def looked_up(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, from the table as far as it goes; what is new is segmented and kept."""
        out = list(map(self.kept.get, parts))
        if None not in out:
            return out
        need = {p for p, x in zip(parts, out, strict=True) if x is None}
        new = {p: self.older[p] for p in need if p in self.older}
        # those of a length together: none waits for longer ones
        short = sorted((p for p in need - new.keys() if len(p) <= 64 and self.between not in p), key=len)
        for at in range(0, len(short), AT_ONCE):
            some = short[at : at + AT_ONCE]
            new.update(zip(some, self.segment_all(some), strict=True))
        if len(self.kept) + len(new) > KEPT // 2:
            self.older, self.kept = self.kept, {}
        self.kept.update(new)
        for p in need - new.keys():
            new[p] = self.segment(p)
        return [new[p] if x is None else x for p, x in zip(parts, out, strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts are taken together up to a number of parts, and a long one in stretches of so many."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[str] = []
        spans: list[tuple[int, int]] = []

        def flush() -> None:
            ids, at = self.looked_up(held), 0
            for k, n in spans:
                out[k].append(b"".join(ids[at : at + n]))
                at += n
            held.clear()
            spans.clear()

        for k, t in enumerate(texts):
            parts = self.parts.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else []
            for at in range(0, len(parts), TOGETHER):
                some = parts[at : at + TOGETHER]
                held += some
                spans.append((k, len(some)))
                if len(held) >= TOGETHER:
                    flush()
        flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype="<i4").tolist())).decode("utf-8", errors="replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


_codecs: dict[str, Codec] = {}


def codec(v: Vocabulary) -> Codec:
    """The worker's codec for ``v``; only the last one used is kept."""
    if v.key not in _codecs:
        _codecs.clear()
        _codecs[v.key] = Codec(v)
    return _codecs[v.key]


def _added(df: DataFrame, extra: str, column: str, function) -> DataFrame:
    """``df`` with columns from ``function`` (batch's column) -> arrays, in the stead of those of the same names."""
    names = [x.split()[0] for x in extra.split(", ")]
    kept = [c for c in df.columns if c not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, len(batch)), 256):
                part = batch.slice(at, 256)
                made = function(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], [*kept, *names])

    return df.select(F.col(f"`{column}`").alias(fresh(df, "_in")), *(f"`{c}`" for c in kept)).mapInArrow(run, schema)


def encode(docs: DataFrame, model_file: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ids (little-endian int32, as binary) and n_pieces. A null text is an empty one, and has no pieces.

    The vocabulary, whose size the model bounds, is read on the driver and sent to the workers.
    """
    v = docs.sparkSession.sparkContext.broadcast(load(model_file or default_model()))

    def function(texts: list[str | None]) -> list[pa.Array]:
        c = codec(v.value)
        ids = c.encode_all([t or "" for t in texts])
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _added(docs, ENCODED, text, function)


def decode(df: DataFrame, model_file: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` stand for; null or no ids are the empty text."""
    v = df.sparkSession.sparkContext.broadcast(load(model_file or default_model()))

    def function(rows: list[bytes | None]) -> list[pa.Array]:
        c = codec(v.value)
        return [pa.array([c.decode(x or b"") for x in rows], pa.string())]

    return _added(df, f"{to} string", ids, function)


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip) of every row: what encoding and decoding made of the text."""
    df = decode(encode(docs.select("doc_id", "text"), model_file).withColumn("_text", F.col("text")), model_file)
    return df.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("_text", F.lit(""))).alias("round_trip"))


def ids_array(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` as an array of int."""
    def function(rows: list[bytes | None]) -> list[pa.Array]:
        sizes = np.cumsum([0, *(len(x or b"") // 4 for x in rows)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(x or b"" for x in rows), dtype="<i4")))]

    return _added(df, f"{ids} array<int>", ids, function)
