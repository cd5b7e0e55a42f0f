"""Co-occurrence graph: nodes rolled up by key, weighted edges, ranked unlinked pairs, hypothesis lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import adjacency, degrees, wedges

GENERIC_CONFIDENCE = 0.5


def roll_up(rows: DataFrame, key: Column, source: str, domain: str, kind: str, order: str, sets: bool = False) -> DataFrame:
    """One node per key: number of sources, domains and occurrences, and the first type.

    ``sets`` gives the sources and domains themselves, for nodes that are small by nature.
    """
    many = (lambda c: F.array_sort(F.collect_set(c))) if sets else F.countDistinct
    return rows.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(many(source).alias("sources"), many(domain).alias("domains"), F.count("*").alias("contexts"), F.min_by(kind, order).alias("type"))


def set_marks(rows: DataFrame, key: str, item: str) -> DataFrame:
    """``(key, size, mark)``: size and fingerprint of the set of items of every key; equal sets have equal marks.

    Sums and exclusive ors of 64-bit hashes: partial aggregation, nothing is gathered however large a set is.
    """
    d = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("key"), F.col(item).alias("i")).distinct()
    return d.groupBy("key").agg(F.count("*").alias("size"), F.struct(F.bit_xor(F.xxhash64("i")).alias("x"), F.sum(F.xxhash64(F.lit(1), "i").cast("decimal(20,0)")).alias("s")).alias("mark"))


def pairs_within(rows: DataFrame, group: str, item: str) -> DataFrame:
    """``(a, b, weight)``: pairs of items that occur in one group, with the number of groups.

    Grows with the square of the items of one group, which is meant for groups that are small by nature (a paper's
    concepts, an order's parts); a large one is still cut into blocks, as a hub is. Items of a group are made distinct
    first, so repeats cost nothing.
    """
    d = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    side = d.select(F.col("g").alias("src"), F.col("i").alias("dst"))
    met = wedges(side.join(degrees(side), "src"))
    return met.groupBy(F.col("p").alias("a"), F.col("q").alias("b")).agg(F.count("*").alias("weight"))


def unlinked_pairs(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``(a, c, bridge_potential, jaccard, novelty)`` of unlinked pairs with a common neighbour.

    ``sources``: (key, size, mark) of :func:`set_marks`. Pairs with equal source sets are left out.
    """
    adj = adjacency(pairs)
    met = wedges(adj.join(degrees(adj), "src")).select(F.col("p").alias("a"), F.col("q").alias("c"))
    common = met.groupBy("a", "c").agg(F.count("*").alias("bridge_potential"))
    open_ = common.join(pairs.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti")
    node = degrees(adj).withColumnRenamed("src", "key").join(sources, "key")
    side = lambda e: node.select(F.col("key").alias(e), F.col("degree").alias(f"d{e}"), F.col("size").alias(f"n{e}"), F.col("mark").alias(f"m{e}"))
    both = open_.join(side("a"), "a").join(side("c"), "c").where("na <> nc OR ma <> mc")
    union = F.col("da") + F.col("dc") - F.col("bridge_potential")
    return both.select("a", "c", "bridge_potential", (F.col("bridge_potential") / union).alias("jaccard"), F.when(F.col("na") != F.col("nc"), "high").otherwise("medium").alias("novelty"))


def lookup_hypotheses(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Hypothesis of each (a, c) in either order, else a generic one of confidence 0.5. ``known``: (x, y, text, confidence)."""
    k = known.select(F.least("x", "y").alias("_x"), F.greatest("x", "y").alias("_y"), "text", "confidence")
    p = pairs.withColumn("_x", F.least("a", "c")).withColumn("_y", F.greatest("a", "c"))
    generic = F.concat(F.col("a"), F.lit(" × "), F.col("c"))
    return p.join(k, ["_x", "_y"], "left").select(*pairs.columns, F.coalesce("text", generic).alias("hypothesis"), F.coalesce("confidence", F.lit(GENERIC_CONFIDENCE)).alias("confidence"))


def circular_layout(nodes: DataFrame, position: str, total: int, radius: float = 180.0, centre: tuple[float, float] = (400.0, 250.0)) -> DataFrame:
    """Places on a circle for nodes numbered from 0."""
    angle = F.col(position) * F.lit(2.0) * F.pi() / F.lit(total)
    return nodes.withColumn("x", F.lit(centre[0]) + F.lit(radius) * F.cos(angle)).withColumn("y", F.lit(centre[1]) + F.lit(radius) * F.sin(angle))
