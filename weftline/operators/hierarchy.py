"""Inferred is-a relations: candidate bands, the cascade of heuristics, quotas and insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.rules import TYPE_RANK, lookup
from weftline.operators.graph import insert_undirected
from weftline.operators.ranking import top_in_group

NAME_MIN = 3  # names must be longer


def _verdict(relation: str, confidence: float, reason: Column) -> Column:
    return F.struct(F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), reason.alias("reasoning"))


def infer(a: str = "a", b: str = "b") -> Column:
    """``(relation, confidence, reasoning)`` of two concept structs (jp_name, en_name, definition, concept_type, sources).

    The first rule that applies decides: name containment 0.7, mention in the definition 0.6, rank of the types 0.4,
    two or more sources more 0.3. For name containment each name of A is compared with the names of B in order; the
    last name of A that has a verdict decides, and the reasons of all are joined. The texts of the reasons are fixed
    values: they are part of the result.
    """
    names = {s: [F.lower(F.coalesce(F.col(f"{s}.{n}"), F.lit(""))) for n in ("jp_name", "en_name")] for s in (a, b)}
    text = {s: F.lower(F.coalesce(F.col(f"{s}.definition"), F.lit(""))) for s in (a, b)}
    rank = {s: lookup(F.col(f"{s}.concept_type"), TYPE_RANK, 0) for s in (a, b)}
    count = {s: F.coalesce(F.col(f"{s}.sources"), F.lit(0)) for s in (a, b)}

    def within(inner: Column, outer: Column) -> Column:
        return (F.length(inner) > NAME_MIN) & outer.contains(inner) & (inner != outer)

    per_name = []
    for x in names[a]:
        options = []
        for y in names[b]:
            ok = (x != "") & (y != "")
            options.append(F.when(ok & within(x, y), _verdict("B_is_a_A", 0.7, F.format_string("B's name contains A's name: '%s' contains '%s'", y, x))))
            options.append(F.when(ok & within(y, x), _verdict("A_is_a_B", 0.7, F.format_string("A's name contains B's name: '%s' contains '%s'", x, y))))
        per_name.append(F.coalesce(*options))
    second = F.when(names[a][1] == names[a][0], F.lit(None)).otherwise(per_name[1])  # equal names are one name
    reasons = F.concat_ws("; ", per_name[0]["reasoning"], second["reasoning"])
    last = F.coalesce(second, per_name[0])
    h1 = F.when(last.isNotNull(), F.struct(last["relation"].alias("relation"), last["confidence"].alias("confidence"), reasons.alias("reasoning")))

    def mention(who: str, of: str, relation: str, label: str) -> Column:
        return F.coalesce(*[F.when((F.length(n) > NAME_MIN) & text[who].contains(n), _verdict(relation, 0.6, F.concat(F.lit(label), n, F.lit("'")))) for n in names[of]])

    h2 = F.coalesce(mention(a, b, "A_is_a_B", "A's definition mentions B: '"), mention(b, a, "B_is_a_A", "B's definition mentions A: '"))
    t = {s: F.coalesce(F.col(f"{s}.concept_type"), F.lit("")) for s in (a, b)}
    h3 = F.when(rank[a] > rank[b], _verdict("B_is_a_A", 0.4, F.format_string("Type hierarchy: %s(%d) > %s(%d)", t[a], rank[a], t[b], rank[b]))).when(
        rank[a] < rank[b], _verdict("A_is_a_B", 0.4, F.format_string("Type hierarchy: %s(%d) > %s(%d)", t[b], rank[b], t[a], rank[a]))
    )
    n = {s: count[s].cast("int") for s in (a, b)}
    h4 = F.when(n[a] - n[b] >= 2, _verdict("B_is_a_A", 0.3, F.format_string("Source count: A(%d) > B(%d)", n[a], n[b]))).when(
        n[b] - n[a] >= 2, _verdict("A_is_a_B", 0.3, F.format_string("Source count: B(%d) > A(%d)", n[b], n[a]))
    )
    return F.coalesce(h1, h2, h3, h4, _verdict("no_relation", 0.0, F.lit("No clear hierarchical relationship")))


def orient(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """``(source, target, type, confidence, reasoning)``, child to parent, of ``(id_a, id_b, relation, confidence, reasoning)``."""
    a_child = F.col("relation") == "A_is_a_B"
    return pairs.where((F.col("confidence") >= least) & (F.col("relation") != "no_relation")).select(
        F.when(a_child, F.col("id_a")).otherwise(F.col("id_b")).alias("source"), F.when(a_child, F.col("id_b")).otherwise(F.col("id_a")).alias("target"),
        F.lit("subsumption").alias("type"), "confidence", "reasoning",
    )


def isolated_first(pairs: DataFrame, isolated_ids: DataFrame, first: int = 400, others: int = 100, order: tuple = ()) -> DataFrame:
    """Quotas: up to ``first`` pairs with an isolated end and ``others`` without, each in order."""
    one = isolated_ids.select("id").distinct().withColumn("_i", F.lit(True))
    flagged = pairs.join(one.select(F.col("id").alias("id_a"), F.col("_i").alias("_ia")), "id_a", "left").join(one.select(F.col("id").alias("id_b"), F.col("_i").alias("_ib")), "id_b", "left")
    flagged = flagged.withColumn("isolated", F.coalesce("_ia", "_ib", F.lit(False))).drop("_ia", "_ib")
    ranked = top_in_group(flagged, "isolated", list(order), max(first, others))
    return ranked.where(F.col("rank") <= F.when(F.col("isolated"), first).otherwise(others))


def merge_inferred(edges: DataFrame, inferred: DataFrame, least: float = 0.4) -> DataFrame:
    """Inferred relations of enough confidence that are new in either direction; of several the most confident."""
    good = inferred.where(F.col("confidence") >= least).withColumn("type", F.coalesce("type", F.lit("subsumption"))).withColumn("inferred", F.lit(True))
    return insert_undirected(edges, good, F.struct(-F.col("confidence"), F.col("source"), F.col("target")))
