"""Concept graph: projections, adjacency, degrees, isolated nodes and A-B-C gaps.

A gap is a pair A, C of nodes that share a neighbour B but have no edge. The wedge join grows with the square of a
bridge's degree, so hubs are taken out by an anti join before it; that removes the cost and the skew at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import rules

HUB_DEGREE = 15


def nodes(concepts: DataFrame, id_col: str = "concept_id") -> DataFrame:
    """Node projection with label fallback, size by sources and colour by axes."""
    size = F.size(F.coalesce("source_papers", F.array().cast("array<string>")))
    return concepts.select(
        F.col(id_col).alias("id"), F.coalesce(F.nullif("jp_name", F.lit("")), "en_name", F.lit("")).alias("label"), F.coalesce("en_name", F.lit("")).alias("en_label"),
        F.coalesce("zh_name", F.lit("")).alias("zh_label"), F.coalesce("concept_type", F.lit("unknown")).alias("type"), F.coalesce("country_tag", F.lit(rules.DEFAULT_COUNTRY)).alias("country_tag"),
        (size * 5 + 10).alias("size"), rules.axis_color(F.col("four_axis")).alias("color"), F.coalesce("definition", F.lit("")).alias("definition"),
    )


def edge_projection(relationships: DataFrame) -> DataFrame:
    """Edges with id, label, width and style by type."""
    t = F.coalesce("type", F.lit("co_occurrence"))
    return relationships.select(
        F.concat_ws("-", "source", "target").alias("id"), "source", "target", t.alias("type"), F.coalesce("description", F.lit("")).alias("label"),
        rules.lookup(t, rules.EDGE_WIDTH, 1).alias("width"), rules.lookup(t, rules.EDGE_STYLE, "solid").alias("style"),
    )


def build_graph(concepts: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a one-row table of counts."""
    n, e = nodes(concepts), edge_projection(relationships)
    counts = n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges")))  # one row each
    return n, e, counts


def undirected(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Each edge once as ``(a, b)`` with a < b; loops and open ends are dropped."""
    s, t = F.col(source), F.col(target)
    return edges.where(s.isNotNull() & t.isNotNull() & (s != t)).select(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).distinct()


def adjacency(pairs: DataFrame) -> DataFrame:
    """Both directions of ``(a, b)`` as ``(src, dst)``; one pass over the pairs."""
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src").agg(F.count("*").alias("degree"))


def hubs(adj: DataFrame, threshold: int = HUB_DEGREE) -> DataFrame:
    return degrees(adj).where(F.col("degree") > threshold)


def isolated(node_ids: DataFrame, adj: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Ids without edge; with ``related(src, dst)`` also without mention."""
    touched = adj.select(F.col("src").alias("id"))
    if related is not None:
        touched = touched.unionByName(related.select(F.col("src").alias("id"))).unionByName(related.select(F.col("dst").alias("id")))
    return node_ids.join(touched, "id", "left_anti")


WEDGE_BLOCK = 1_000


def wedges(side: DataFrame, block: int = WEDGE_BLOCK) -> DataFrame:
    """``(p, bridge, q, degree)``, p < q: all pairs of neighbours of every node of ``side(src, dst, degree)``.

    The pairs of a hub are its degree squared; its neighbours are cut into blocks that meet all the others one block at
    a time, so no task has more than ``block`` times a hub's degree.
    """
    parts = F.ceil(F.col("degree") / block).cast("int")
    x = side.select(F.col("src").alias("bridge"), F.col("dst").alias("p"), "degree", F.pmod(F.xxhash64("dst"), parts).cast("int").alias("part"))
    y = side.select(F.col("src").alias("bridge"), F.col("dst").alias("q"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return x.join(y, ["bridge", "part"]).where(F.col("p") < F.col("q")).select("p", "bridge", "q", "degree")


def gaps(pairs: DataFrame, hub_threshold: int | None = None) -> DataFrame:
    """``(a, b, c, degree)``: unlinked A, C (A < C) over every bridge B; hubs are no bridges if a threshold is given."""
    adj = adjacency(pairs)
    deg = degrees(adj)
    side = adj.join(deg, "src")
    if hub_threshold is not None:
        side = side.where(F.col("degree") <= hub_threshold)
    met = wedges(side).select(F.col("p").alias("a"), F.col("bridge").alias("mid"), F.col("q").alias("b"), "degree")
    open_ = met.join(pairs, ["a", "b"], "left_anti")
    return open_.select("a", F.col("mid").alias("b"), F.col("b").alias("c"), "degree")


def with_labels(found: DataFrame, labels: DataFrame, default: str = "?", columns: tuple[str, ...] = ("label",)) -> DataFrame:
    """Adds ``<end>_<column>`` of A, B and C; a missing label becomes ``default``."""
    out = found
    for end in ("a", "b", "c"):
        side = labels.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        out = out.join(side, end, "left")
        if "label" in columns:
            out = out.withColumn(f"{end}_label", F.coalesce(f"{end}_label", F.lit(default)))
    return out


def gap_key() -> Column:
    return F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string"))


def score_gaps(found: DataFrame, country: tuple[str, str] = ("a_country", "c_country"), kind: tuple[str, str] = ("a_type", "c_type"), type_bonus: float = 0.5) -> DataFrame:
    """``1 + 2 [countries differ] + type_bonus [types differ] + 1 / degree of B``, three decimals."""
    cross = F.col(country[0]) != F.col(country[1])
    score = 1.0 + F.when(cross, 2.0).otherwise(0.0) + F.when(F.col(kind[0]) != F.col(kind[1]), type_bonus).otherwise(0.0) + F.try_divide(F.lit(1.0), F.col("degree"))
    return found.withColumn("cross_country", F.coalesce(cross, F.lit(False))).withColumn("score", F.round(score, 3)).withColumn("gap_type", F.when(F.coalesce(cross, F.lit(False)), "cross_country").otherwise("indirect_connection"))


def insert_directed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New edges whose (source, target) is not there yet; each once."""
    return new.dropDuplicates(["source", "target"]).join(existing.select("source", "target"), ["source", "target"], "left_anti")


def insert_undirected(existing: DataFrame, new: DataFrame, order: Column | str) -> DataFrame:
    """New edges not there in either direction; of several, also turned round, the first by ``order``."""
    key = lambda df: df.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target"))
    cols = new.columns
    first = key(new).groupBy("_a", "_b").agg(F.min_by(F.struct(*cols), order).alias("s"))
    return first.join(key(existing).select("_a", "_b"), ["_a", "_b"], "left_anti").select("s.*")


def dangling(new: DataFrame, node_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends among the nodes, and the missing ends ``(source, target, missing)`` of the others."""
    s = node_ids.select(F.col("id").alias("source"), F.lit(True).alias("_s"))
    t = node_ids.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    both = new.join(s, "source", "left").join(t, "target", "left")
    bad = both.where(F.col("_s").isNull() | F.col("_t").isNull())
    missing = bad.select("source", "target", F.explode(F.filter(F.array(F.when(F.col("_s").isNull(), F.col("source")), F.when(F.col("_t").isNull(), F.col("target"))), lambda x: x.isNotNull())).alias("missing"))
    return both.where("_s AND _t").drop("_s", "_t"), missing
