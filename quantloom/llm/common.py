"""What the operators of this subpackage share: inputs, cut points, and hashing of words."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: What separates words: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of this process where it is unset, as in tests."""
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    now = spark.sparkContext.getCheckpointDir()
    if now is None:
        if not set_by and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(set_by or tempfile.mkdtemp(prefix="quantloom-"))
        now = spark.sparkContext.getCheckpointDir()
    return now


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, and go on from there: what follows survives lost executors and is not computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, by a compressed table of which later steps read the columns that they need; for what has many rows."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Remove a written folder, and the table that stands for it, once nothing reads it any more."""
    if table is not None:
        spark.sql(f"drop table if exists {table}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column; columns differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole(text: str = "text") -> F.Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(text), F.lit(""))


# --- hashing ---------------------------------------------------------------

U = np.uint64
#: Texts are hashed in stretches of about so many bytes, which bounds a worker's memory.
STRETCH = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = np.asarray(x, dtype=U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix((np.arange(start, start + n, dtype=U)) * U(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = seeds(256)
_FOLDED = _BYTE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STRETCH + 4096)
        out = np.empty(size, dtype=U)
        out[0] = 1
        done = 1
        while done < size:
            k = min(done, size - done)
            out[done : done + k] = out[:k] * U(pow(base, done, 1 << 64))
            done += k
        _powers[base] = have = out
    return have[:n]


def running(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Running polynomial hash of bytes: what ``window_hashes`` and ``word_hashes`` take differences of."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def window_hashes(run: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes from each of ``starts``."""
    return mix((run[starts + length] - run[starts]) * powers(_INVERSE, len(run))[starts])


def _stretches(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first text, number of texts, joined bytes) of up to about STRETCH bytes; a longer text comes alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STRETCH:
            yield first, i - first, b"\n".join(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts) - first, b"\n".join(texts[first:])


def _hash_words(data: bytes, table: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``, between bytes of ``space``. Words of over STRETCH bytes have a hash of another kind."""
    hashes, starts, at = [], [], 0
    view = np.frombuffer(data, dtype=np.uint8)
    while at < len(data):
        end = min(at + STRETCH, len(data))
        if end < len(data):  # cut at a space; a word of over STRETCH bytes is taken alone
            gaps = np.flatnonzero(space[view[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and not space[view[end]]:
                    end += 1
                word = bytes(view[at:end])
                if table is _FOLDED:
                    word = word.lower()
                starts.append(np.array([at]))
                hashes.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), dtype=U))
                at = end
                continue
        part = view[at:end]
        edge = np.diff(space[part].view(np.int8), prepend=1, append=1)
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        run = running(part, table)
        starts.append(s + at)
        hashes.append(mix((run[e] - run[s]) * powers(_INVERSE, len(run))[s] ^ (e - s).astype(U)))
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    return np.concatenate(starts), np.concatenate(hashes)


def word_hashes(texts: list[bytes], fold: bool = True) -> Iterator[np.ndarray]:
    """For each text in turn, the 64-bit hashes of its words; ``fold``: A-Z as a-z."""
    table = _FOLDED if fold else _BYTE
    with np.errstate(over="ignore"):
        for first, n, data in _stretches(texts):
            starts, hashes = _hash_words(data, table)
            ends = np.cumsum([len(t) + 1 for t in texts[first : first + n]])
            at = 0
            for stop in np.searchsorted(starts, ends):
                yield hashes[at:stop]
                at = stop


_SHINGLE = [U(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, 65)]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words, in order; of the whole sequence if it is shorter; none without words."""
    width = min(width, len(words))
    if not width:
        return words
    with np.errstate(over="ignore"):
        n = len(words) - width + 1
        out = words[:n] * _SHINGLE[0] + U(width)
        for k in range(1, width):
            out += words[k : k + n] * _SHINGLE[k]
        return mix(out)
