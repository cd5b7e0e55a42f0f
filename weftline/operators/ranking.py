"""Top-k in groups, diversified gaps and hypotheses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.rules import RESEARCH_QUESTIONS
from weftline.functions.text import contains_any


def top_in_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of every group with their ``rank``; a group-limit runs before the shuffle."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diversify(found: DataFrame, per_bridge: int = 5, total: int = 50) -> DataFrame:
    """Best gaps by score, ties by (a, b, c), at most ``per_bridge`` of one bridge: equal to the greedy pass."""
    capped = top_in_group(found, "b", [F.col("score").desc(), F.col("a"), F.col("c")], per_bridge).drop("rank")
    return capped.orderBy(F.col("score").desc(), "a", "b", "c").limit(total)


def diversity(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("gaps"), F.countDistinct("b").alias("bridges"), F.countDistinct("a").alias("a_ends"), F.countDistinct("c").alias("c_ends"), F.count_if("cross_country").alias("cross_country"))


def shared_axes_type(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Hypothesis type and the axes it rests on: shared by A and C, else B's own, else none."""
    shared = F.array_sort(F.array_intersect(a, c))
    bridge = F.array_sort(F.array_except(b, F.array_union(a, c)))
    kind = F.when(F.size(shared) > 0, "共通軸").when(F.size(bridge) > 0, "橋渡し").otherwise("探索的")
    return kind, F.when(F.size(shared) > 0, shared).otherwise(bridge)


def research_questions(text: Column) -> Column:
    """The research questions any keyword of which occurs."""
    return F.filter(F.array(*[F.when(contains_any(text, ks), F.lit(q)) for q, ks in RESEARCH_QUESTIONS.items()]), lambda x: x.isNotNull())


def priority(questions: Column) -> Column:
    return F.when(F.size(questions) >= 2, "high").when(F.size(questions) >= 1, "medium").otherwise("low")


def hypotheses(found: DataFrame, concepts: DataFrame, limit: int = 20) -> DataFrame:
    """A typed, prioritised hypothesis for each of the first ``limit`` gaps (by score, then ends).

    ``concepts``: id, name, four_axis, definition. Only the chosen gaps are joined.
    """
    top = found.orderBy(F.col("score").desc(), "a", "b", "c").limit(limit)
    out = top
    for end in ("a", "b", "c"):
        out = out.join(concepts.select(F.col("id").alias(end), F.struct("name", "four_axis", "definition").alias(f"{end}_")), end, "left")
    empty = F.array().cast("array<string>")
    axes = {e: F.coalesce(F.col(f"{e}_.four_axis"), empty) for e in "abc"}
    kind, on = shared_axes_type(axes["a"], axes["b"], axes["c"])
    name = {e: F.coalesce(F.col(f"{e}_.name"), F.col(e)) for e in "abc"}
    dump = F.to_json(F.array("a_", "b_", "c_"))
    questions = research_questions(F.coalesce(dump, F.lit("")))
    statement = F.format_string("「%s」と「%s」は「%s」を介して関連する可能性がある。", name["a"], name["c"], name["b"])
    return out.select("a", "b", "c", "score", kind.alias("hypothesis_type"), F.array_join(on, ",").alias("axes"), statement.alias("statement"), F.array_join(questions, ",").alias("rq"), priority(questions).alias("priority"))
