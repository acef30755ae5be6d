"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges to a partition in the rounds. They shrink fast, and edges in a single partition are not shuffled.
ROWS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())


def _held(edges: DataFrame) -> tuple[DataFrame, tuple, Callable]:
    """Written; its state; and how to join what is grouped from it, which is broadcast if it has at most ROWS rows."""
    edges = cut(edges)
    state = _state(edges)
    return edges.coalesce(max(1, -(-state[0] // ROWS))), state, F.broadcast if state[0] <= ROWS else lambda df: df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (u, v, of one orderable type) the least node that it is linked with.

    Edges with a null end are left out; loops and repeated edges change nothing; an empty table gives an empty one.
    """
    e = (
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e, before, small = _held(e)
    while before[0]:
        # large star: every greater neighbour of a node gets the least of the node's neighbourhood
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: every lesser neighbour of a node, and the node, get the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e, after, small = _held(linked.filter("u <> v").distinct())
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def star_components(stars: DataFrame) -> DataFrame:
    """As ``connected_components``, for edges (rep, member) of which a rep may have very many.

    Members are contracted first: a member's reps are linked with the least of them, so that only reps meet in the rounds,
    and a rep with a third of all members is no hot key. Tables that are joined by rep are written first, so that Spark may split what is skewed.
    """
    stars = cut(stars.filter("rep is not null and member is not null").distinct())
    least = stars.groupBy("member").agg(F.min("rep").alias("first"))
    reps = cut(stars.select(F.col("rep").alias("u")).distinct())
    # a rep can be a member of other stars too
    linked = stars.join(least, "member").select(F.col("rep").alias("u"), F.col("first").alias("v")).filter("u <> v")
    own = least.join(reps, F.col("member") == F.col("u"), "left_semi").select(F.col("member").alias("u"), F.col("first").alias("v"))
    comp = cut(connected_components(linked.union(own)).withColumnRenamed("component", "c"))
    member = least.join(comp.withColumnRenamed("node", "first"), "first", "left").select("member", F.coalesce("c", "first").alias("c"))
    rep = reps.withColumnRenamed("u", "node").join(comp, "node", "left").select("node", F.coalesce("c", "node").alias("c"))
    return rep.union(member).groupBy("node").agg(F.min("c").alias("component"))
