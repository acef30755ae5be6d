"""Document fingerprints by consistent weighted sampling, in built-in expressions alone.

A document's terms are its words, weighted by how often they occur. For each of K samples every term draws r and c from Gamma(2, 1)
and b from [0, 1), all three from hashes of term and sample number, and so the same in every document:

    t = floor(ln w / r + b),   ln a = ln c - r * (t - b + 1)

The term of the least a is the sample, with its t. Two documents' samples agree with a probability that is their generalised Jaccard
similarity, sum(min(w, w')) / sum(max(w, w')) (Ioffe, 2010).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, fresh

K = 24
#: Rows that stand in one run of neighbouring ids, and the most such runs.
RUN, MOST_RUNS = 1000, 50_000


def _unit(h: Column, shift: int) -> Column:
    """A number within (0, 1) from 32 bits of a hash."""
    bits = F.shiftrightunsigned(h, shift) if shift else h.bitwiseAND(F.lit(0xFFFFFFFF))
    return (bits.cast("double") + 0.5) / float(1 << 32)


def sampled(term: Column, log_weight: Column, k: int) -> Column:
    """Sample ``k`` of one term: ln a in fixed point above 31 bits of a hash of (term, t), so that the least such number is the sample."""
    h1 = F.xxhash64(term, F.lit(k))
    h2 = F.xxhash64(h1, F.lit(-1))
    h3 = F.xxhash64(h2, F.lit(-2))
    r = -F.ln(_unit(h1, 32) * _unit(h1, 0))
    c = -F.ln(_unit(h2, 32) * _unit(h2, 0))
    b = _unit(h3, 32)
    t = F.floor(log_weight / r + b)
    a = F.ln(c) - r * (t.cast("double") - b + 1.0)
    fixed = F.floor((F.least(F.greatest(a, F.lit(-127.0)), F.lit(127.0)) + 128.0) * float(1 << 23))
    return F.shiftleft(fixed.cast("long"), 31).bitwiseOR(F.xxhash64(h3, t).bitwiseAND(F.lit(0x7FFFFFFF)))


def signatures(rows: DataFrame, keys: list[str], text: str, k: int = K) -> DataFrame:
    """(*keys, signature): an array of ``k`` numbers for each of ``keys`` that has words. No shuffle if ``rows`` are dealt by some of the keys."""
    words = rows.select(*keys, F.explode(F.split(text, SPACES)).alias("_w")).filter("_w <> ''").select(*keys, F.xxhash64("_w").alias("_t"))
    terms = words.groupBy(*keys, "_t").agg(F.count("*").alias("_n"))
    terms = terms.withColumn("_l", F.ln(F.col("_n").cast("double")))
    least = terms.groupBy(*keys).agg(*(F.min(sampled(F.col("_t"), F.col("_l"), i)).alias(f"_s{i}") for i in range(k)))
    return least.select(*keys, F.array(*(F.col(f"_s{i}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for i in range(k))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of positions at which two signatures agree; 1 if both texts have no words, 0 if one has none."""
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def text_of(signature: Column) -> Column:
    """A signature as eight hexadecimal digits a position; '' if there is none."""
    return F.coalesce(F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), "")), F.lit(""))


def fingerprints(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """``docs`` with fingerprint (text of its signature)."""
    docs = docs.drop("fingerprint")
    row, sign = fresh(docs, "_row"), fresh(docs, "signature")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    own = signatures(keyed.select(F.col(row).alias("_row"), F.coalesce(text, F.lit("")).alias("_x")), ["_row"], "_x", k)
    own = own.select(F.col("_row").alias(row), F.col("signature").alias(sign))
    return keyed.join(own, row, "left").withColumn("fingerprint", text_of(F.col(sign))).drop(row, sign)


def _runs(docs: DataFrame) -> DataFrame:
    """(run, ghost, doc_id, text): rows dealt to runs of ids, in each the run before it's last row as a ghost, in front.

    Runs lie between quantiles of the ids, so that outlying ids make none larger; rows without an id are runs below these, dealt by a hash of
    their text. The last row before the first run's is the last of all.
    """
    ids, missing = docs.agg(F.count("doc_id"), F.sum(F.col("doc_id").isNull().cast("long"))).first()
    runs, empty = max(1, min(MOST_RUNS, ids // RUN)), max(1, min(MOST_RUNS, (missing or 0) // RUN))
    edges: list[int] = []
    if runs > 1:
        shares = ", ".join(f"{k / runs!r}D" for k in range(1, runs))
        edges = sorted(set(docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 4 * runs)})")).first()[0]))
    bounds, up = F.expr(f"cast(array({', '.join(map(str, edges))}) as array<bigint>)"), max(1, len(edges)).bit_length()
    # how many edges are at or under the id, by halving
    steps = F.array(*(F.lit(1 << k) for k in range(up, -1, -1)))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    run = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(empty)).cast("int")).otherwise(place)
    # never null, and known so: a filter for that on one side of a later join would keep both sides from reading one shuffle of the texts
    run = F.coalesce(run, F.lit(0))
    rows = docs.select(run.alias("run"), F.lit(False).alias("ghost"), "doc_id", "text")
    # the last row of each run: of repeated ids, that of the greatest text
    tops = rows.groupBy("run").agg(F.max("doc_id").alias("top"))
    first = tops.agg(F.min("run")).first()[0]
    to = tops.select("run", "top", F.coalesce(F.expr("lead(run) over (order by run)"), F.lit(first)).alias("to"))
    # at most MOST_RUNS + 1 rows of three numbers
    ghosts = rows.join(F.broadcast(cut(to).withColumnRenamed("run", "_run")), (F.col("run") == F.col("_run")) & F.col("doc_id").eqNullSafe(F.col("top")))
    ghosts = ghosts.groupBy("to", "doc_id").agg(F.max("text").alias("text")).select(F.col("to").alias("run"), F.lit(True).alias("ghost"), "doc_id", "text")
    return rows.union(ghosts)


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document's, which
    is the next smaller doc_id's; the smallest one's is the greatest's. Of rows that repeat a doc_id, the smaller text comes later;
    rows without doc_id come after all others, in an order that their texts give. A null text is an empty one. An empty table gives an empty one. A text without words
    has the fingerprint ''; two such are alike, and unlike any other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _runs(docs)
    order = "(partition by run order by ghost desc, doc_id asc nulls first, text)"
    rows = rows.withColumn("row", F.expr(f"row_number() over {order}")).withColumn("next", F.expr(f"lag(text) over {order}"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    changed = F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 3)))"), F.expr("substring(coalesce(next, ''), 1, int(floor(n_chars / 3)))"))
    rows = rows.withColumn("changed", F.when(F.col("ghost"), F.lit("")).otherwise(changed))
    sides = rows.select("run", "row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("x")), F.struct(F.lit(1).alias("side"), F.col("changed").alias("x")))).alias("s"))
    signed = signatures(sides.select("run", "row", "s.side", "s.x"), ["run", "row", "side"], "x", k)
    signed = signed.groupBy("run", "row").agg(F.max(F.when(F.col("side") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("signature"))).alias("other"))
    facts = rows.select("run", "row", "ghost", "doc_id", "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"))
    both = facts.join(signed, ["run", "row"], "left").withColumn("next", F.expr("lag(own) over (partition by run order by row)"))
    return both.filter(~F.col("ghost")).select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
