"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.ids import canonical_id
from weftline.llm import components, knn, mixing, packing, scanned, splitting, survivorship, topn
from weftline.session import table

ATTRIBUTES = (
    survivorship.Attribute("definition"),
    survivorship.Attribute("four_axis", array=True),
    survivorship.Attribute("context_quotes", array=True),
    survivorship.Attribute("source_papers", array=True),
)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.concept_groups(table(spark, d, "concept"), table(spark, d, "provenance_trust"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.suppliers(survivorship.survivors(_groups(spark, d), ATTRIBUTES, with_values=False), ATTRIBUTES)


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, with the supplier of every field."""
    return survivorship.survivors(_groups(spark, d), ATTRIBUTES)


def p1_survivor_texts(spark: SparkSession, d: str) -> DataFrame:
    """As ``p1_survivors``, the entries of arrays sorted and joined."""
    rows = p1_survivors(spark, d)
    return rows.select(*[F.array_join(F.array_sort(a.name), "|").alias(a.name) if a.array else a.name for a in ATTRIBUTES], "group_id", *[f"{a.name}_from" for a in ATTRIBUTES])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top_gaps(spark, d).select("concept_b", "key")


def p2_top_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The five best current gaps of every bridge concept, with score and rank."""
    rows = table(spark, d, "gaps").select("key", canonical_id("concept_b").alias("concept_b"), F.col("score").cast("double").alias("score"), "generated_at")
    current = topn.latest_per_key(rows, "key", "generated_at", [F.col("score").desc_nulls_last(), "concept_b"])
    return topn.top_n(current, "concept_b", "score", "key", 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk")
    return scanned.noise(chunks, scanned.learn(chunks))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs of every source."""
    chunks = table(spark, d, "chunk")
    return scanned.repaired(chunks, scanned.learn(chunks))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar concepts of every concept, with the cosine."""
    rows = table(spark, d, "concept_vec").select(canonical_id("concept_id").alias("id"), "vec")
    return knn.nearest(rows, k=3, dim=64)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbour_pairs(p5_neighbours(spark, d)).select(F.col("a").alias("concept_a"), F.col("b").alias("concept_b"))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index: every concept whose number is divisible by 20, against all rows by brute force."""
    rows = knn.usable_vectors(table(spark, d, "concept_vec").select(canonical_id("concept_id").alias("id"), "vec"), "id", "vec", 64)
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("long")
    exact = knn.exact_neighbours(rows, rows.where(number % 20 == 0).dropDuplicates(["id"]), 3, 64)
    return knn.recall(exact, p5_neighbours(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.connected_components(components.merge_pairs(table(spark, d, "merge_candidates")))
    return groups.withColumnRenamed("id", "concept_id")


def _limit(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "size_limit").where(F.lower(F.trim("purpose")) == purpose).first()
    return row.max_tokens, row.overlap_tokens


def _packed(spark: SparkSession, d: str, purpose: str) -> tuple[DataFrame, int]:
    capacity, _ = _limit(spark, d, purpose)
    return packing.pack(packing.items(table(spark, d, "documents"), capacity), capacity), capacity


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of an oversized text, with its container."""
    return _packed(spark, d, "container")[0].withColumnRenamed("id", "doc_id")


def p8_containers_long(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "container_long")[0].withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(*_packed(spark, d, "container"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a text in the mixture, with the source it counts for."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p10_plan(spark: SparkSession, d: str) -> DataFrame:
    """Byte offsets and tokens of the pieces of every oversized document."""
    return splitting.split_documents(table(spark, d, "documents"), *_limit(spark, d, "piece"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_plan(spark, d).where("part = 0 AND piece = 0").select(F.col("id").alias("doc_id"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces with their text."""
    limit, _ = _limit(spark, d, "piece")
    return splitting.with_text(table(spark, d, "documents"), p10_plan(spark, d), limit=limit).withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p1_survivor_texts": p1_survivor_texts,
    "p2_found": p2_found,
    "p2_top_gaps": p2_top_gaps,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_recall": p5_recall,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_containers_long": p8_containers_long,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_plan": p10_plan,
    "p10_pieces": p10_pieces,
}
