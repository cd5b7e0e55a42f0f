"""Parent-child links to full hierarchies, by splitters.

Every node has at most one parent.  Deterministic hash splitters (and all roots) cut the forest into short runs:

1. *walk*: every node follows parents to its next splitter, doubling its stride each round and carrying the exact
   run of ids, so a run of length L needs log2(L) rounds;
2. *reduce*: the splitters with their next splitters form a graph about ``spacing`` times smaller, which is walked
   to the roots in the same way;
3. *expand*: each node's path is its splitter's path followed by its own run: one join.

If a round ends no walk, every walk left is endless: a node at distance d from its end has, after r rounds, an
ancestor at distance between 2^r and 2^(r+1), which would have ended.  Those nodes are on, or lead into, a cycle;
in step 1 that is a cycle without a splitter, in step 2 one with.

Edge cases: null or blank ends take no part; an edge to itself is a cycle; repeated links count once; several
parents are resolved before (``single_parent``); an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import canonical_id, enum_value, newest_first
from weftline.session import cut_lineage

CYCLE = "CYCLE"
#: Normalised spellings of the subsumption type.
SUBSUMPTION = ("subsumption", "isa")


def subsumption_links(edges: DataFrame) -> DataFrame:
    """``(child, parent, at)`` of the edges of the subsumption type that have both ends."""
    return edges.where(enum_value("type").isin(*SUBSUMPTION)).select(
        canonical_id("source").alias("child"), canonical_id("target").alias("parent"), F.col("created_at").alias("at")
    ).where(F.col("child").isNotNull() & F.col("parent").isNotNull())


def single_parent(links: DataFrame) -> DataFrame:
    """``(node, parent)`` for every end of a link: the latest parent, ties by smaller id; null for roots."""
    both = links.select(F.col("child").alias("node"), F.struct(newest_first("at").alias("k"), F.col("parent").alias("p")).alias("s")).unionByName(
        links.select(F.col("parent").alias("node"), F.lit(None).cast("struct<k:interval day to second,p:string>").alias("s"))
    )
    return both.groupBy("node").agg(F.min("s").alias("s")).select("node", F.col("s.p").alias("parent"))


def _walk(table: DataFrame) -> DataFrame:
    """Follow ``ptr`` until ``done``. Rows: node, ptr, run, hops, done. Rows still not done at the end are endless."""
    table = cut_lineage(table)
    left = table.where(~F.col("done")).count()
    ended, open_ = table.where("done"), table.where("NOT done")  # what has ended is written once and only looked up
    while left:
        step = ended.unionByName(open_).select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("run").alias("run2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"), (F.col("hops") == 0).alias("end"))
        moved = open_.join(step, "ptr", "left").select(
            "node", F.col("ptr2").alias("ptr"), F.when(F.col("end"), F.col("run")).otherwise(F.concat_ws(">", "run2", "run")).alias("run"),
            (F.col("hops") + F.col("hops2")).alias("hops"), F.col("done2").alias("done"),
        )
        moved = cut_lineage(moved)
        ended, open_ = ended.unionByName(moved.where("done")), moved.where("NOT done")
        now = open_.count()
        if now == left:
            break
        left = now
    return ended.unionByName(open_)


def hierarchies(parents: DataFrame, spacing: int = 4) -> DataFrame:
    """``(node_id, root_id, depth, path)`` for every node of ``parents(node, parent)``.

    Nodes on a cycle or leading into one get root ``CYCLE``, depth -1 and an empty path.
    ``spacing``: one node in so many is a splitter.
    """
    split = lambda c: F.pmod(F.xxhash64(F.lit("splitter"), c), F.lit(spacing)) == 0
    root = F.col("parent").isNull()
    walked = _walk(
        parents.select(
            "node", F.coalesce("parent", "node").alias("ptr"), F.when(root, F.lit("")).otherwise(F.col("node")).alias("run"),
            F.when(root, 0).otherwise(1).alias("hops"), (root | split(F.col("parent"))).alias("done"),
        )
    )
    runs, endless = walked.where("done"), walked.where("NOT done").select("node")
    # The reduced graph: splitters only. A root is a splitter that points to itself in no hops.
    reduced = runs.where((F.col("hops") == 0) | split(F.col("node")))
    solved = _walk(reduced.select("node", "ptr", "run", "hops", (F.col("hops") == 0).alias("done")))
    ends = solved.where("done").select(F.col("node").alias("ptr"), F.col("ptr").alias("root_id"), F.col("hops").alias("hops2"), F.when(F.col("hops") == 0, F.col("ptr")).otherwise(F.concat_ws(">", "ptr", "run")).alias("path2"))
    found = runs.join(ends, "ptr", "left").select(
        F.col("node").alias("node_id"), F.coalesce("root_id", F.lit(CYCLE)).alias("root_id"),
        F.when(F.col("root_id").isNull(), -1).otherwise(F.col("hops") + F.col("hops2")).cast("int").alias("depth"),
        F.when(F.col("root_id").isNull(), "").when(F.col("hops") == 0, F.col("path2")).otherwise(F.concat_ws(">", "path2", "run")).alias("path"),
    )
    lost = endless.select(F.col("node").alias("node_id"), F.lit(CYCLE).alias("root_id"), F.lit(-1).alias("depth"), F.lit("").alias("path"))
    return found.unionByName(lost)


def descendants(nodes: DataFrame) -> DataFrame:
    """``(node_id, descendant_id, distance)`` from the paths of :func:`hierarchies`; no further join is needed."""
    ids = F.split("path", ">")
    return (
        nodes.where(F.col("depth") > 0)
        .select(F.col("node_id").alias("descendant_id"), F.posexplode(F.slice(ids, 1, F.size(ids) - 1)), F.col("depth"))
        .select(F.col("col").alias("node_id"), "descendant_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
    )


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """``(node_id, descendants, height)``; partial sums keep a root over a third of all rows cheap."""
    below = descendants(nodes).groupBy("node_id").agg(F.count("*").alias("descendants"), F.max("distance").alias("height"))
    return nodes.select("node_id").join(below, "node_id", "left").select("node_id", F.coalesce("descendants", F.lit(0)).alias("descendants"), F.coalesce("height", F.lit(0)).alias("height"))
