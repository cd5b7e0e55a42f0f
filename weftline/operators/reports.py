"""Markdown reports. Rows are chosen and counted in Spark; only the lines shown reach the driver.

A list that a report gives in full has no bound: it is in the text, or, where a path is given, written there as JSON
lines by Spark and only named and counted in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.rules import AXES, TIERS
from weftline.functions.text import SHOWN_LENGTHS, truncate
from weftline.operators.ranking import top_in_group
from weftline.sources.writers import write_jsonl

SHOWN = 2_000


def _rows(df: DataFrame):
    return df.take(SHOWN)


def _written(df: DataFrame, path: str) -> str:
    write_jsonl(df, path)
    return f"{df.sparkSession.read.text(path).count()} rows: {path}"


def table(headers: list[str], rows) -> str:
    return "\n".join(["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def axis_report(predictions: DataFrame, k: int = 10) -> str:
    """Concepts by dominant axis, and the best of each. ``predictions``: id, name, dominant_axis, score."""
    counts = {r.dominant_axis: r.n for r in predictions.groupBy("dominant_axis").agg(F.count("*").alias("n")).collect()}  # four axes
    best = _rows(top_in_group(predictions, "dominant_axis", [F.col("score").desc(), F.col("id")], k))
    out = ["# RQ1", table(["axis", "concepts"], [(AXES[a], counts.get(a, 0)) for a in AXES])]
    for a in AXES:
        out.append(f"## {AXES[a]}\n" + "\n".join(f"{r['rank']}. {r['name']} ({r['score']:.2f})" for r in sorted((r for r in best if r.dominant_axis == a), key=lambda r: r["rank"])))
    return "\n\n".join(out)


def impact_report(labelled: DataFrame, k: int = 5) -> str:
    """Concepts by impact label, the first of each and how many more. ``labelled``: id, name, definition, label."""
    counts = _rows(labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label"))
    first = _rows(top_in_group(labelled.withColumn("definition", truncate("definition", SHOWN_LENGTHS["reported"])), "label", [F.col("id")], k))
    out = ["# RQ2", table(["category", "label", "concepts"], [(r.label.split("_")[0], r.label, r.n) for r in counts])]
    for c in counts:
        lines = [f"- {r['name']}: {r['definition']}" for r in sorted((r for r in first if r.label == c.label), key=lambda r: r["rank"])]
        if c.n > k:
            lines.append(f"- 他 {c.n - k}")
        out.append(f"## {c.label}\n" + "\n".join(lines))
    return "\n\n".join(out)


#: The comparison of the systems of China and Japan at the end of the third report.
COMPARISON = (
    ("信用中国（統一プラットフォーム）", "JICC/CIC/KSC（分散3機関）", "統一 vs 分散", "連携強化の余地"),
    ("統一社会信用コード (USCI)", "法人番号", "用途・連結範囲", "活用範囲拡大検討"),
    ("連合懲戒（多領域制裁）", "暴力団排除条項（限定的）", "対象・範囲", "慎重な検討必要"),
    ("ブラックリスト（公開）", "反社データベース（非公開）", "透明性 vs 秘匿性", "設計思想の相違"),
    ("信用修復制度", "なし", "事後救済", "**導入検討の余地大**"),
    ("分類規制（信用ベース検査）", "一律対応", "規制効率化", "**導入検討の余地大**"),
)


def with_tier(rows: DataFrame) -> DataFrame:
    """``recommendation`` as one of the three tiers; any other value counts as the middle one."""
    return rows.withColumn("recommendation", F.when(F.col("recommendation").isin(*TIERS), F.col("recommendation")).otherwise(TIERS[1]))


def home_rows(rows: DataFrame) -> DataFrame:
    return rows.where("country_tag = 'JP'").select("id", "name", "recommendation")


def gap_rows(gaps: DataFrame, cross: int = 15, same: int = 5) -> DataFrame:
    """The best gaps between countries, then within, numbered through as ``n``."""
    ranked = top_in_group(gaps, "cross_country", [F.col("score").desc(), F.col("a"), F.col("b"), F.col("c")], max(cross, same))
    chosen = ranked.where(F.col("rank") <= F.when(F.col("cross_country"), cross).otherwise(same))
    return chosen.withColumn("n", F.row_number().over(Window.orderBy(F.col("cross_country").desc(), "rank"))).drop("rank")  # a few rows


def validation_rows(per_source: DataFrame, isolated: DataFrame, k: int = 20) -> DataFrame:
    """``(list, id)``: the first sources of low density, those not processed and the isolated concepts."""
    low = per_source.where("status = 'LOW_DENSITY'").orderBy("density", "source_id").limit(k).select(F.lit("low density").alias("list"), F.col("source_id").alias("id"))
    none = per_source.where("status = 'NOT_PROCESSED'").orderBy("source_id").limit(k).select(F.lit("not processed").alias("list"), F.col("source_id").alias("id"))
    return low.unionByName(none).unionByName(isolated.orderBy("id").limit(k).select(F.lit("isolated").alias("list"), "id"))


def transfer_report(rows: DataFrame, k: int = 10, home_path: str | None = None) -> str:
    """Recommendations, the first concepts of each, and all of Japan. ``rows``: id, name, country_tag, recommendation, score.

    ``home_path``: where the concepts of Japan are written, if not into the text.
    """
    rows = with_tier(rows)
    counts = {r.recommendation: r.n for r in rows.groupBy("recommendation").agg(F.count("*").alias("n")).collect()}  # three tiers
    first = _rows(top_in_group(rows, "recommendation", [F.col("score").desc(), F.col("id")], k))
    home = home_rows(rows).orderBy("id")
    listed = table(["id", "name", "recommendation"], home.toLocalIterator()) if home_path is None else _written(home, home_path)
    out = ["# RQ3", table(["recommendation", "concepts"], [(t, counts.get(t, 0)) for t in TIERS]), "## JP\n" + listed]
    for t in TIERS:
        out.append(f"## {t}\n" + "\n".join(f"- {r['name']} ({r['score']:.2f})" for r in sorted((r for r in first if r.recommendation == t), key=lambda r: r["rank"])))
    out.append("## CN / JP\n" + table(["CN", "JP", "gap", "lesson"], COMPARISON))
    return "\n\n".join(out)


def hypothesis_report(hypotheses: DataFrame, medium: int = 5, high_path: str | None = None) -> str:
    """All hypotheses of high priority, the first of medium, and counts.

    ``high_path``: where those of high priority are written, if not into the text.
    """
    counts = {r.priority: r.n for r in hypotheses.where(F.col("priority").isin("high", "medium", "low")).groupBy("priority").agg(F.count("*").alias("n")).collect()}
    order = [F.col("score").desc(), "a", "b", "c"]
    high = hypotheses.where("priority = 'high'").orderBy(*order)
    mid = hypotheses.where("priority = 'medium'").orderBy(*order).limit(medium).collect()
    block = lambda n, r: f"### {n}. {r['statement']}\n- {r['hypothesis_type']} {r['axes']}\n- {r['rq']}\n- score {r['score']}"
    parts = ["# Hypotheses", table(["priority", "n"], [(p, counts.get(p, 0)) for p in ("high", "medium", "low")])]
    if high_path is None:
        parts += [block(n, r) for n, r in enumerate(high.toLocalIterator(), 1)]
    else:
        parts.append("## High\n" + _written(high, high_path))
    parts += [block(n, r) for n, r in enumerate(mid, counts.get("high", 0) + 1)]
    return "\n\n".join(parts)


def gap_report(gaps: DataFrame, cross: int = 15, same: int = 5) -> str:
    """Gaps between countries, then within, numbered through."""
    rows = gap_rows(gaps, cross, same).orderBy("n").collect()
    return "\n".join(["# Gaps", *(f"{r['n']}. {r['a_label']} – {r['b_label']} – {r['c_label']} ({r['score']})" for r in rows)])


def validation_report(summary: DataFrame, per_source: DataFrame, countries: DataFrame, isolated: DataFrame, k: int = 20) -> str:
    """Coverage figures, countries, sources of low density or without concepts, isolated concepts."""
    s = summary.first().asDict()
    low = _rows(per_source.where("status = 'LOW_DENSITY'").orderBy("density", "source_id").limit(k))
    none = _rows(per_source.where("status = 'NOT_PROCESSED'").orderBy("source_id").limit(k))
    alone, n = _rows(isolated.orderBy("id").limit(k)), isolated.count()
    more = max(0, s.get("not_processed", 0) - len(none))
    return "\n\n".join([
        "# Validation", table(["figure", "value"], s.items()), "## Countries\n" + table(["country", "concepts", "percent"], _rows(countries.orderBy(F.desc("n")))),
        "## Low density\n" + table(["source", "density"], [(r.source_id, r.density) for r in low]),
        "## Not processed\n" + "\n".join(f"- {r.source_id}" for r in none) + (f"\n- {more} more" if more else ""),
        f"## Isolated ({n})\n" + "\n".join(f"- {r.id}" for r in alone),
    ])
