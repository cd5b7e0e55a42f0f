"""Consolidating pairwise matches into groups: alternating large-star and small-star.

Each round rewrites the edge list twice by distributed joins:

* large-star links every larger neighbour of a node to the smallest id in its neighbourhood;
* small-star links a node and its smaller neighbours to the smallest of them.

It ends when a round leaves the edge list unchanged; every record then points to the smallest id of its component.
The minimum is a partially aggregated ``groupBy``, the rewrite a join with one row per node, so a node with a third
of all pairs is never gathered in one task: the adaptive join splits it. Each round is written to the checkpoint
folder; only a count and a checksum reach the driver.

Edge cases: null and blank ids and pairs of a record with itself give no edge (a record that is only paired with
itself is in no group); repeated and turned-round pairs count once; no pairs give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import canonical_id, enum_value
from weftline.session import cut_lineage


def merge_pairs(candidates: DataFrame, action: str = "merge") -> DataFrame:
    """``(a, b)`` of the candidates whose action is ``action``, however spelled."""
    return candidates.where(enum_value("action") == action).select(canonical_id("concept_a.id").alias("a"), canonical_id("concept_b.id").alias("b"))


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges are larger -> smaller."""
    m = _smallest(edges)
    moved = edges.join(m, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def _sum() -> Column:
    return F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, group_id)`` for every id in a pair of two different ids; group_id is the component's smallest id."""
    ca, cb = F.col(a), F.col(b)
    edges = cut_lineage(pairs.where(ca.isNotNull() & cb.isNotNull() & (ca != cb)).select(F.greatest(ca, cb).alias("u"), F.least(ca, cb).alias("v")).distinct())
    before = edges.agg(F.count("*"), _sum()).first()
    for _ in range(max_rounds if before[0] else 0):
        edges = cut_lineage(_small_star(_large_star(edges)))
        after = edges.agg(F.count("*"), _sum()).first()
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    heads = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("group_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(heads)
