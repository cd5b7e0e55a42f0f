"""The steps of a discovery run put together; every step is a plan, nothing runs until it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import dedup, graph, hierarchy, maintain, ranking


def ingest(texts: DataFrame, size: int = text.CHUNK_SIZE) -> DataFrame:
    """``(source_id, source_file, chunk_index, char_count, text)`` of texts of at least 100 characters."""
    rows = texts.where(F.length("text") >= text.DOCUMENT_MIN)
    return rows.select("source_id", "source_file", F.posexplode(text.chunks("text", size)).alias("chunk_index", "text")).withColumn("char_count", F.length("text"))


def update_concepts(existing: DataFrame, new: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The concept table with new extractions merged in, and the relations its definitions mention.

    Both tables have the concept columns; existing rows come before new ones, and rows without id get the next ids.
    """
    old = existing.withColumn("_new", F.lit(0)).withColumn(order, F.col("concept_id"))
    add = new.withColumn("_new", F.lit(1)).withColumn("concept_id", F.lit(None).cast("string"))
    rows = old.unionByName(add, allowMissingColumns=True).withColumn("_ord", F.struct("_new", order))
    scalars = ("concept_id", "en_name", "jp_name", "zh_name", "concept_type", "definition", "country_tag", "related_concepts")
    merged = dedup.deduplicate(rows, "_ord", scalars, ("source_papers", "four_axis"), "context_quotes")
    have = merged.where("concept_id IS NOT NULL")
    fresh = dedup.assign_ids(merged.where("concept_id IS NULL").drop("concept_id"), "key", existing=existing)
    concepts = have.unionByName(fresh).drop("key", "records")
    names = concepts.select(F.col("concept_id").alias("id"), F.explode(F.array("en_name", "jp_name", "zh_name")).alias("name")).where("name IS NOT NULL")
    found = maintain.mentions(names, concepts.select(F.col("concept_id").alias("id"), F.col("definition").alias("text")))
    return concepts, found.select("source", "target", F.lit("reference").alias("type"), F.concat(F.lit("mentions "), "name").alias("description"))


def predict(concepts: DataFrame, id_col: str = "concept_id") -> DataFrame:
    """Impact labels, axis scores and transferability of every concept in one pass."""
    d = F.coalesce("definition", F.lit(""))
    scores = rules.axis_scores(d, F.col("four_axis"))
    out = concepts.select(id_col, F.inline(F.array(F.struct(rules.predict_impact(d).alias("impact"), *[c.alias(k) for k, c in scores.items()], *[c.alias(k) for k, c in rules.transferability(d).items()]))))
    return out.select(
        id_col, F.col("impact.label").alias("labels"), F.map_from_arrays("impact.label", "impact.confidence").alias("confidence"), F.col("impact")[0]["label"].alias("primary_impact"),
        *scores, rules.dominant_axis({k: F.col(k) for k in scores}).alias("dominant_axis"), "transparency_score", "relief_score", "proportionality_score", "transferability_score", "recommendation",
    )


def infer_hierarchy(concepts: DataFrame, candidates: DataFrame, edges: DataFrame, id_col: str = "concept_id") -> DataFrame:
    """New is-a edges of candidate pairs ``(id_a, id_b, cos)``: isolated ends first, heuristics, then insertion."""
    ids = concepts.select(F.col(id_col).alias("id"))
    lone = graph.isolated(ids, graph.adjacency(edges.select(F.col("source").alias("a"), F.col("target").alias("b"))))
    chosen = hierarchy.isolated_first(candidates, lone, order=(F.col("cos").desc(), F.col("id_a"), F.col("id_b")))
    s = F.struct("jp_name", "en_name", "definition", "concept_type", F.coalesce(F.size("source_papers"), F.lit(0)).alias("sources"))
    side = lambda e: concepts.select(F.col(id_col).alias(f"id_{e}"), s.alias(e))
    pairs = chosen.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", F.inline(F.array(hierarchy.infer("a", "b"))))
    return hierarchy.merge_inferred(edges, hierarchy.orient(pairs))


def discover(concepts: DataFrame, edges: DataFrame, hub: int = graph.HUB_DEGREE, per_bridge: int = 5, total: int = 50, id_col: str = "concept_id") -> tuple[DataFrame, DataFrame]:
    """Diversified gaps with labels, prompt and key, and the hypotheses of the first twenty."""
    n = graph.nodes(concepts, id_col).select("id", "label", F.col("country_tag").alias("country"), "type")
    scored = graph.score_gaps(graph.with_labels(graph.gaps(graph.undirected(edges), hub), n, columns=("label", "country", "type")))
    best = ranking.diversify(scored, per_bridge, total).withColumn("key", graph.gap_key())
    best = best.withColumn("hypothesis_prompt", F.format_string("How could %s and %s be related by way of %s?", "a_label", "c_label", "b_label"))
    named = concepts.select(F.col(id_col).alias("id"), F.coalesce("jp_name", "en_name").alias("name"), "four_axis", "definition")
    return best, ranking.hypotheses(best, named)


def merge_duplicates(concepts: DataFrame, edges: DataFrame, candidates: DataFrame, confidence: str = "high") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan, and concepts (``id``) and edges after it. ``candidates``: ord, a, b, confidence."""
    plan = maintain.merge_plan(candidates, confidence)
    mapping = maintain.greedy_map(plan, concepts.select("id"))
    return plan, maintain.apply_merges(concepts, mapping), maintain.redirect(edges, mapping)


CONDITION_NAMES = ("透明性要件", "救済メカニズム", "民間関与度", "データ連結度", "制裁強度")


def condition_examples(recommended: DataFrame) -> DataFrame:
    """Training examples ``(instruction, input, output)`` from ``(condition, verdict, name, rank)``.

    A condition without recommendation gives none; input and output are JSON in a string.
    """
    spark = recommended.sparkSession
    texts = spark.createDataFrame([(i, dict(zip(CONDITION_NAMES, c))) for i, c in enumerate(rules.CONDITIONS)], "condition int, c map<string,string>")
    names = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("name")))).alias(v)
    rows = recommended.groupBy("condition").agg(names("recommended"), names("not_recommended")).where(F.size("recommended") > 0)
    return rows.join(texts, "condition").select(F.lit("以下の条件を満たすSCS制度要素を推薦してください。").alias("instruction"), F.to_json("c").alias("input"), F.to_json(F.struct("recommended", "not_recommended")).alias("output"))
