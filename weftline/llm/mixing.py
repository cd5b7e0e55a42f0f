"""Mixing sources to target weights: min-cost flow over membership patterns.

Copies of one text under several sources make the sources overlap: a text may serve any source it is found in.

1. Texts (by digest) are grouped by the set of target sources they occur in, their *pattern*; with S sources there
   are at most 2^S patterns, in practice a few dozen, and only these counts reach the driver.
2. Token capacity flows from repetition layers of patterns to source quotas. The r-th use of a pattern costs r - 1
   a token (convex), so nothing is repeated while something unused can serve; a pattern can be used at most as
   often as the strictest of its sources allows. The size of the mixture is the largest at which every source that
   has any text reaches its share, unless it is given.
   A use is named by the smallest id that the text has in the source it counts for.
3. Within a pattern texts are ordered by a seeded hash; prefix sums of tokens, in two levels, turn each flow into
   an interval of that order, and a text is used by the source in whose interval its middle lies.

Sources without any text can't reach their share: theirs is spread over the others in proportion, and the report
gives both the target and what was reached. A source misses its share by at most half a text at either end of an interval.

Edge cases: null and empty texts and documents of a source without target take no part; spellings of a source are
equal apart from case, outer white space and ``-``, `` `` for ``_``; a null or zero share asks for nothing; an empty
table gives an empty mixture; extra columns are ignored; equal hashes are decided by the digest.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.tokens import DEFAULT_TOKENIZER, token_count
from weftline.session import cut_lineage

BUCKETS = 4096
SOURCES_MAX = 24


def source_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n 　"))), r"[-\s]+", "_")


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def targets(mix: DataFrame) -> list[Target]:
    """The target table, which is small by nature: more than SOURCES_MAX sources are refused."""
    rows = mix.where(F.coalesce("target_share", F.lit(0.0)) > 0).groupBy(source_name("source").alias("s")).agg(F.sum("target_share").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).where("s IS NOT NULL").orderBy("s").take(SOURCES_MAX + 1)
    if len(rows) > SOURCES_MAX:
        raise ValueError(f"more than {SOURCES_MAX} sources")
    return [Target(r.s, float(r.w), max(1, int(r.r))) for r in rows]


class Flow:
    """Min-cost flow on a small graph by successive shortest paths."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.cost, self.out = n, [], [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        """Send as much as possible at least cost; the amount sent."""
        sent, potential = 0, [0] * self.n
        while True:
            dist, via = [None] * self.n, [-1] * self.n
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.cap[e] and (dist[y] is None or d + self.cost[e] + potential[x] - potential[y] < dist[y]):
                        dist[y], via[y] = d + self.cost[e] + potential[x] - potential[y], e
                        heapq.heappush(heap, (dist[y], y))
            if dist[t] is None:
                return sent
            potential = [p + (d if d is not None else 0) for p, d in zip(potential, dist)]
            push, x = None, t
            while x != s:
                push = self.cap[via[x]] if push is None else min(push, self.cap[via[x]])
                x = self.to[via[x] ^ 1]
            x = t
            while x != s:
                self.cap[via[x]] -= push
                self.cap[via[x] ^ 1] += push
                x = self.to[via[x] ^ 1]
            sent += push


def route(patterns: dict[tuple[str, ...], int], goals: list[Target], size: int | None = None) -> tuple[dict[tuple[tuple[str, ...], int, str], int], int]:
    """Tokens by (pattern, layer, source), and the size of the mixture."""
    have = {s for p in patterns for s in p}
    goals = [g for g in goals if g.source in have]
    whole = sum(g.share for g in goals)
    if not goals:
        return {}, 0
    limit = {g.source: g.repeats for g in goals}
    keys = sorted(patterns)

    def solve(total: int):
        f = Flow(2 + len(keys) + len(goals))
        edges = {}
        for i, p in enumerate(keys):
            for r in range(min(limit[s] for s in p)):
                edges[p, r] = f.edge(0, 2 + i, patterns[p], r)
        serve = {(p, g.source): f.edge(2 + i, 2 + len(keys) + j, 1 << 60) for i, p in enumerate(keys) for j, g in enumerate(goals) if g.source in p}
        quota = [int(total * g.share / whole) for g in goals]
        for j, q in enumerate(quota):
            f.edge(2 + len(keys) + j, 1, q)
        return f.run(0, 1) == sum(quota), f, edges, serve

    if size is None:
        lo, hi = 0, sum(n * min(limit[s] for s in p) for p, n in patterns.items()) + len(goals)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if solve(mid)[0] else (lo, mid - 1)
        size = lo
    _, f, edges, serve = solve(size)
    out = {}
    for p in keys:
        rooms = [[r, f.cap[e ^ 1]] for (q, r), e in edges.items() if q == p]
        for g in goals:
            if (p, g.source) in serve:
                need = f.cap[serve[p, g.source] ^ 1]
                for room in rooms:
                    if need and room[1]:
                        part = min(need, room[1])
                        out[p, room[0], g.source] = part
                        need, room[1] = need - part, room[1] - part
    return out, size


def mixture(documents: DataFrame, mix: DataFrame, size: int | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, use, tokens)`` of the mixture and ``(source, target_share, actual_share, tokens, uses)``."""
    spark = documents.sparkSession
    goals = targets(mix)
    s = source_name(source_col)
    rows = documents.where(s.isin(*[g.source for g in goals]) & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), s.alias("s"), F.md5(F.col(text_col)).alias("digest"), token_count(F.col(text_col), tokenizer).alias("n"))
    # The smallest id of a text in each source; at most SOURCES_MAX columns, so a text of many copies is summed up before the shuffle.
    own = [F.struct(F.lit(g.source).alias("source"), F.min(F.when(F.col("s") == g.source, F.col("id"))).alias("id")) for g in goals]
    texts = cut_lineage(
        rows.groupBy("digest").agg(F.max("n").alias("tokens"), F.filter(F.array(*own), lambda x: x["id"].isNotNull()).alias("own"))
        .withColumn("pattern", F.col("own.source"))
        .withColumn("h", F.xxhash64(F.lit(seed), "digest"))
        .withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    )
    counts = {tuple(r.pattern): int(r.t) for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("t")).collect()}  # at most 2^S rows
    flow, _ = route(counts, goals, size)
    spans, at = [], {}
    for (p, r, src), n in sorted(flow.items()):
        lo = at.get((p, r), 0)
        at[p, r] = lo + n
        spans.append((list(p), r + 1, src, lo, lo + n))
    kind = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("use", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    intervals = F.broadcast(spark.createDataFrame(spans, kind))  # bounded by patterns x repeats x sources

    order = Window.partitionBy("pattern").orderBy("bucket")
    bases = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t")).withColumn("base", F.sum("t").over(order) - F.col("t")).drop("t")
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = texts.join(bases, ["pattern", "bucket"]).withColumn("middle", F.col("base") + F.sum("tokens").over(inside) - F.col("tokens") / 2)
    used = placed.join(intervals, "pattern").where((F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi")))
    mine = F.filter("own", lambda x: x["source"] == F.col("source"))[0]["id"]
    chosen = used.select(mine.alias(id_col), "source", "use", F.col("tokens").cast("long").alias("tokens"))
    goal_rows = spark.createDataFrame([(g.source, g.share, g.repeats) for g in goals], "source string, target_share double, max_repeats int")
    total = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("use").alias("most_uses"))
    report = (
        goal_rows.join(total, "source", "left").fillna(0, ["tokens", "uses", "most_uses"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy()).cast("double")), F.lit(0.0)))
    )
    return chosen, report
