"""Merkle manifest of a table: leaf digests, one tree a group, one tree over the groups, and a proof for each row.

Levels are windows: the nodes of a level are partitioned by group and parent, and an ordered list over the full frame of such a run is
at once the parent's preimage and, without the node itself, its siblings. Of each run one row goes on as the parent.

A stage climbs some levels without shuffling: its nodes are dealt by (group, block), a block being the nodes under one node of the
stage's last level, and every level's windows are partitioned by these and the parent. Each node carries the stage's nodes below it
with the siblings met so far, so that a stage ends with one row a block. Stages are written, and the next one has a fraction of the
rows. Then paths come down again: a block's row is joined with what its last node met above, once a stage. No task holds more than a
block, whatever a group's size; places in a group come from range partitions and their offsets, not from one window a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

FANOUT = 2
#: Nodes under the last node of a stage, at most.
BLOCK = 64
#: A row's fields, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tables of so many rows at most are broadcast.
SMALL = 20_000
_PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, ':' and itself; '-' for null. Integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place in its group by ``order`` (nulls first), and n, the group's rows.

    Rows are dealt to ranges of (group, order), sorted there and numbered; a range adds what lies before it in its group.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    at = written(at.withColumn("range", F.shiftright("at", 33)))
    # a row a range and group: of ranges, each has more than one group only where groups end within it
    held = at.groupBy("range", group).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = W.partitionBy(group).orderBy("range")
    held = held.withColumn("before", F.coalesce(F.sum("rows").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    held = written(held.withColumn("n", F.sum("rows").over(W.partitionBy(group))))
    held = held.select(F.col("range").alias("_range"), F.col(group).alias("_group"), "first", "before", "n")
    held = F.broadcast(held) if held.count() <= SMALL else held
    found = at.join(held, (F.col("range") == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).select(*rows.columns, "idx", "n")


def _levels(fanout: int) -> int:
    """How many levels a stage climbs."""
    n = 1
    while fanout ** (n + 1) <= BLOCK:
        n += 1
    return n


def _stage(nodes: DataFrame, fanout: int) -> DataFrame:
    """(group, idx, n, digest, below): the nodes some levels above ``nodes`` (group, idx, n, digest), each with the nodes under it and their siblings on the way.

    ``n`` is the number of the group's nodes on a level; a group's only node stays as it is.
    """
    up = _levels(fanout)
    now = nodes.withColumn("block", F.expr(f"idx div {fanout**up}")).repartition("group", "block")
    now = now.withColumn("below", F.array(F.struct("idx", F.array().cast(_PATH).alias("path"))))
    for _ in range(up):
        run = W.partitionBy("group", "block", "parent").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        now = now.withColumn("parent", F.expr(f"idx div {fanout}"))
        now = now.withColumn("run", F.collect_list(F.struct("digest", "below")).over(run))
        # one row a run: its first
        now = now.filter(f"idx % {fanout} = 0")
        digests = F.col("run.digest")
        step = lambda i: F.struct(
            F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"), F.array_join(F.slice(digests, i + 2, F.size(digests)), "").alias("after")
        )
        met = F.transform("run", lambda r, i: F.transform(r["below"], lambda b: F.struct(b["idx"].alias("idx"), F.concat(b["path"], F.array(step(i))).alias("path"))))
        alone = F.col("n") == 1
        now = now.select(
            "group", "block", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
            F.when(alone, F.col("digest")).otherwise(digest(F.array_join(digests, ""))).alias("digest"), F.when(alone, F.col("below")).otherwise(F.flatten(met)).alias("below"),
        )
    return now.drop("block")


def climbed(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The stages above ``nodes`` (group, idx, n, digest), each written; in the last, every group has one node."""
    stages = []
    while True:
        top = written(_stage(nodes, fanout))
        stages.append(top)
        if (top.agg(F.max("n")).first()[0] or 1) == 1:
            return stages
        nodes = top.drop("below")


def descended(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(group, idx, path, *more): the path of each of the lowest nodes: the siblings on all levels, from the lowest one up.

    ``tops`` (group, path, *more) has what lies above each group's last node.
    """
    more = [c for c in tops.columns if c not in ("group", "path")]
    above = tops.withColumn("idx", F.lit(0).cast("long"))
    for stage in reversed(stages):
        joined = stage.select("group", "idx", "below").join(above, ["group", "idx"])
        above = joined.select("group", F.explode("below").alias("b"), "path", *more).select("group", "b.idx", F.concat("b.path", "path").alias("path"), *more)
    return above


def manifest(docs: DataFrame, fanout: int = FANOUT, group: str = "lang", tampered: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs`` (the columns of ``FIELDS``; no other is read).

    A leaf is the digest of the row's encoded fields. Rows of one ``group`` (null is one too) ascend by doc_id, a null one first; rows of
    one doc_id by their leaves, so that the manifest does not depend on how rows are dealt. Where ``tampered`` divides the CRC-32 of the
    doc_id, the row is checked with n_chars raised by one, which a null one bears unchanged; a null doc_id is not tampered with. Repeated
    rows are leaves of their own. A null or empty text is a field like others; an empty table gives an empty one.
    """
    long, text = (lambda c: F.col(c).cast("long")), (lambda c: F.col(c).cast("string"))
    rows = docs.select(long("doc_id").alias("doc_id"), text("source").alias("source"), text("lang").alias("lang"), long("n_chars").alias("n_chars"), text("text").alias("text"), F.col(group).cast("string").alias("group"))
    leaf = digest(*(encoded(F.col(c)) for c in FIELDS))
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(tampered)) == 0
    wrong = F.when(changed, digest(*(encoded(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS)))
    leaves = written(rows.select("group", "doc_id", leaf.alias("leaf"), wrong.alias("wrong")))
    leaves = placed(leaves, "group", ["doc_id", "leaf"])
    # joins by a group that may be null: the group as text that tells null from all values
    leaves = written(leaves.withColumn("group", F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))))
    stages = climbed(leaves.select("group", "idx", "n", F.col("leaf").alias("digest")), fanout)
    subroots = stages[-1].select(F.lit("").alias("group"), "digest", F.col("group").alias("of"))
    over = placed(subroots, "group", ["of"])
    over = written(over)
    roots = climbed(over.select("group", "idx", "n", "digest"), fanout)
    root = roots[-1].first()
    root = None if root is None else root["digest"]
    tops = descended(roots, roots[-1].select("group", F.array().cast(_PATH).alias("path")).distinct())
    tops = written(tops.select("idx", "path").join(over, "idx").select(F.col("of").alias("group"), "path", F.col("digest").alias("subroot")))
    paths = descended(stages, tops)
    df = leaves.select("group", "idx", "doc_id", "leaf", "wrong").join(paths, ["group", "idx"])
    folded = F.aggregate("path", F.coalesce("wrong", "leaf"), lambda a, x: digest(x["before"], a, x["after"]))
    proof = digest(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""))
    df = df.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_encoded(c: str) -> str:
    return f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')"


def _sql_digest(shift: int) -> str:
    return "sha256(" + " || ".join(_sql_encoded(f"{c} + {shift}" if shift and c == "n_chars" else c) for c in FIELDS) + ")"


#: The same in DuckDB. CRC-32 is folded over the bits of the digits; paths are followed upwards, a level a step.
SQL = f"""
with recursive d as (
  select *, coalesce('=' || lang, '') as grp, {_sql_digest(0)} as leaf, {_sql_digest(1)} as wrong,
    list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [-1 - ascii(c), 0, 0, 0, 0, 0, 0, 0, 0])),
      lambda x, y: case when y < 0 then xor(x, -1 - y) when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as folded_crc
  from documents),
leaves as materialized (
  select doc_id, grp, leaf, case when xor(folded_crc, 4294967295) % {7} = 0 then wrong else leaf end as checked,
    row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by grp) as n from d),
nodes as (
  select grp, 0 as level, idx, n, leaf as digest from leaves
  union all
  select grp, any_value(level) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by idx)) from nodes where n > 1 group by grp, idx // 2),
tree as materialized (select * from nodes),
subroots as materialized (select grp, digest as subroot, row_number() over (order by grp) - 1 as place, count(*) over () as groups from tree where n = 1),
tops as (
  select 0 as level, place as idx, groups as n, subroot as digest from subroots
  union all
  select any_value(level) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by idx)) from tops where n > 1 group by idx // 2),
peaks as materialized (select * from tops),
climb as (
  select doc_id, leaf, grp, idx as leaf_idx, 0 as level, idx, n, checked as folded, '' as proof from leaves
  union all
  select doc_id, leaf, c.grp, leaf_idx, c.level + 1, c.idx // 2, (c.n + 1) // 2,
    sha256(case when c.idx % 2 = 1 then t.digest || folded else folded || coalesce(t.digest, '') end), proof || coalesce(t.digest, '')
  from climb c left join tree t on t.grp = c.grp and t.level = c.level and t.idx = xor(c.idx, 1) where c.n > 1),
climb2 as (
  select doc_id, leaf, leaf_idx, s.grp, subroot, 0 as level, place as idx, groups as n, folded, proof from climb c join subroots s on s.grp = c.grp where c.n = 1
  union all
  select doc_id, leaf, leaf_idx, grp, subroot, c.level + 1, c.idx // 2, (c.n + 1) // 2,
    sha256(case when c.idx % 2 = 1 then t.digest || folded else folded || coalesce(t.digest, '') end), proof || coalesce(t.digest, '')
  from climb2 c left join peaks t on t.level = c.level and t.idx = xor(c.idx, 1) where c.n > 1)
select doc_id, leaf, subroot, t.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = t.digest as verified from climb2, (select digest from peaks where n = 1) t where climb2.n = 1
"""
