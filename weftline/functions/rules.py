"""Keyword rules as data, and the expressions that apply them.

The keyword lists, labels and numbers are fixed values: results depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import contains_any, contains_count, first_keyword

AXES = {"governance": "ガバナンス", "data_flow": "データフロー", "incentive": "インセンティブ設計", "public_private": "官民関係"}
AXIS_RGB = {"ガバナンス": (231, 76, 60), "データフロー": (52, 152, 219), "インセンティブ設計": (46, 204, 113), "官民関係": (155, 89, 182)}
NO_AXIS_COLOR = "#95a5a6"
EDGE_WIDTH = {"subsumption": 3, "implementation": 2, "causal": 4, "comparison": 2, "co_occurrence": 1, "reference": 1}
EDGE_STYLE = {"subsumption": "solid", "implementation": "dashed", "causal": "solid", "comparison": "dotted", "co_occurrence": "dotted", "reference": "dashed"}
TYPE_RANK = {"theory": 5, "mechanism": 4, "policy": 3, "data_system": 3, "actor": 2, "phenomenon": 1}

#: Country: keywords for the English name, the Japanese name and the sources, in order of evaluation.
COUNTRY = {
    "JP": (("Japan", "Japanese", "JICC", "CIC", "KSC", "Zengin", "JBA"), ("日本", "全銀協", "信用情報機関", "個人信用情報", "暴力団", "反社"), ("Japan", "日本", "NCS", "METI", "FSA", "金融庁", "経済産業省")),
    "US": (("FICO", "US", "American", "Experian", "Equifax", "TransUnion"), ("米国", "アメリカ"), ("US", "American", "FICO", "Fair Isaac")),
    "EU": (("EU", "GDPR", "European", "Brussels"), ("欧州", "EU", "欧州連合"), ("EU", "GDPR", "European", "CURIA", "Brussels")),
    "INTL": (("International", "Global", "Comparative", "Cross-border"), ("国際", "比較", "グローバル"), ("comparative", "international", "global")),
}
DEFAULT_COUNTRY = "CN"

#: Impact labels for training: axis, keywords, label, confidence.
TRAIN_IMPACT = (
    ("インセンティブ設計", ("融資", "信用", "ローン", "金融"), "便益_金融アクセス", 0.8),
    ("インセンティブ設計", ("懲戒", "罰則", "制裁", "blacklist"), "リスク_連鎖制裁", 0.7),
    ("ガバナンス", ("秩序", "取締", "違反", "不正"), "便益_市場秩序", 0.75),
    ("ガバナンス", ("規制", "コンプライアンス", "報告", "義務"), "コスト_コンプライアンス", 0.6),
    ("データフロー", ("共有", "連携", "統合", "データ"), "便益_取引コスト削減", 0.7),
    ("データフロー", ("プライバシー", "個人情報", "監視"), "リスク_プライバシー", 0.8),
)
TRAIN_AXIS = {"governance": ("規制", "監督", "法規", "立法"), "data_flow": ("情報", "データ", "共有", "プラットフォーム"), "incentive": ("報酬", "罰則", "懲戒", "制裁"), "public_private": ("民間", "企業", "官民", "公私")}
#: Impact labels for prediction, in order.
IMPACT = (
    (("融資", "信用", "ローン", "金融", "loan", "credit", "finance"), "便益_金融アクセス", 0.85),
    (("共有", "連携", "効率", "sharing", "integration"), "便益_取引コスト削減", 0.75),
    (("秩序", "取締", "違反", "不正", "order", "enforcement"), "便益_市場秩序", 0.8),
    (("報告", "開示", "義務", "登録", "disclosure", "registration"), "コスト_コンプライアンス", 0.7),
    (("参入", "障壁", "barrier", "entry"), "コスト_参入障壁", 0.65),
    (("連合懲戒", "連鎖", "joint", "punishment"), "リスク_連鎖制裁", 0.9),
    (("恣意", "不透明", "基準", "arbitrary"), "リスク_恣意的運用", 0.7),
    (("プライバシー", "個人情報", "監視", "privacy", "surveillance"), "リスク_プライバシー", 0.85),
)
DEFAULT_IMPACT = ("便益_市場秩序", 0.5)
AXIS_WORDS = {
    "governance": ("規制", "監督", "法", "政策", "regulation", "supervision", "policy", "law"),
    "data_flow": ("情報", "データ", "共有", "プラットフォーム", "data", "information", "platform", "sharing"),
    "incentive": ("報酬", "罰則", "懲戒", "制裁", "制限", "reward", "punishment", "sanction", "restriction"),
    "public_private": ("民間", "企業", "官民", "公私", "private", "public", "company", "corporation"),
}
TRANSPARENT = ("公開", "透明", "開示", "disclosure", "transparent", "public")
RELIEF = ("修復", "救済", "訂正", "回復", "repair", "relief", "correction")
HARSH = ("連合懲戒", "禁止", "制限", "連鎖", "joint punishment", "ban", "restriction")
TIERS = ("移転推奨", "条件付き移転可能", "移転非推奨")
#: Conditions a recommendation is asked for: transparency, relief, private part, linkage, sanction.
CONDITIONS = (("High", "Full", "Med", "Partial", "Soft"), ("Med", "Partial", "High", "Full", "Med"), ("Low", "None", "Low", "Full", "Hard"))
RESEARCH_QUESTIONS = {"RQ1": ("ガバナンス", "データフロー", "インセンティブ", "官民"), "RQ2": ("企業", "融資", "コスト", "リスク", "便益"), "RQ3": ("透明性", "救済", "日本", "移転")}

#: Recommendations by condition: levels, keywords for and against, or by private parties.
RECOMMEND = [
    ("High", "Full", ("修復", "救済", "訂正", "回復"), ("連合懲戒", "制限", "blacklist"), False),
    ("Med", "Partial", None, None, True),
    ("Low", "None", ("懲戒", "制裁", "制限", "禁止"), ("透明", "公開", "救済"), False),
]


def _has_axis(axes: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(axes, name), F.lit(False))


def train_impact(definition: Column, axes: Column, kind: Column) -> Column:
    """Array of (label, confidence): axis-gated, case-sensitive; a default if nothing applies."""
    pair = lambda label, conf: F.struct(F.lit(label).alias("label"), F.lit(conf).alias("confidence"))
    hits = [F.when(_has_axis(axes, a) & contains_any(definition, ks), pair(label, conf)) for a, ks, label, conf in TRAIN_IMPACT]
    hits.append(F.when((kind == "mechanism") & definition.contains("制限"), pair("リスク_恣意的運用", 0.6)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(pair(*DEFAULT_IMPACT)))


def predict_impact(definition: Column) -> Column:
    """Array of (label, confidence): ungated rules in order, on lower-case text."""
    text = F.lower(definition)
    pair = lambda label, conf: F.struct(F.lit(label).alias("label"), F.lit(conf).alias("confidence"))
    found = F.filter(F.array(*[F.when(contains_any(text, ks), pair(label, conf)) for ks, label, conf in IMPACT]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(pair(*DEFAULT_IMPACT)))


def train_axis_scores(definition: Column, axes: Column) -> dict[str, Column]:
    """0.8 or 0.2 by membership, 0.15 more if any keyword is there, at most 1."""
    return {k: F.least(F.lit(1.0), F.when(_has_axis(axes, AXES[k]), 0.8).otherwise(0.2) + F.when(contains_any(definition, ks), 0.15).otherwise(0.0)) for k, ks in TRAIN_AXIS.items()}


def axis_scores(definition: Column, axes: Column) -> dict[str, Column]:
    """0.8 or 0.2 by membership, 0.1 more for each keyword, at most 1, two decimals."""
    text = F.lower(definition)
    return {k: F.round(F.least(F.lit(1.0), F.when(_has_axis(axes, AXES[k]), 0.8).otherwise(0.2) + 0.1 * contains_count(text, ks)), 2) for k, ks in AXIS_WORDS.items()}


def dominant_axis(scores: dict[str, Column]) -> Column:
    """The axis of the highest score; of equal ones the first in order."""
    top = F.greatest(*scores.values())
    return F.coalesce(*[F.when(s == top, F.lit(k)) for k, s in scores.items()])


def transferability(definition: Column) -> dict[str, Column]:
    """Mean of transparency, relief and proportionality, rounded after the tier is chosen."""
    text = F.lower(definition)
    harsh = contains_any(text, HARSH)
    t = F.lit(0.5) + F.when(contains_any(text, TRANSPARENT), 0.3).otherwise(0.0) - F.when(harsh, 0.2).otherwise(0.0)
    r = F.lit(0.5) + F.when(contains_any(text, RELIEF), 0.4).otherwise(0.0)
    p = F.lit(0.5) - F.when(harsh, 0.3).otherwise(0.0)
    mean = (t + r + p) / 3
    tier = F.when(mean > 0.6, TIERS[0]).when(mean > 0.4, TIERS[1]).otherwise(TIERS[2])
    return {"transparency_score": F.round(t, 2), "relief_score": F.round(r, 2), "proportionality_score": F.round(p, 2), "transferability_score": F.round(mean, 2), "recommendation": tier}


def country_match(en: Column, jp: Column, sources: Column) -> Column:
    """(tag, reason) of the first matching country, field and keyword; the default country otherwise."""
    hits = []
    for tag, lists in COUNTRY.items():
        for field, value, words in zip(("en_name", "jp_name", "source"), (en, jp, sources), lists):
            k = first_keyword(F.coalesce(value, F.lit("")), words)
            hits.append(F.when(k.isNotNull(), F.struct(F.lit(tag).alias("tag"), F.concat(F.lit(f'{field} contains "'), k, F.lit('"')).alias("reason"))))
    return F.coalesce(*hits, F.struct(F.lit(DEFAULT_COUNTRY).alias("tag"), F.lit("default").alias("reason")))


def lookup(c: Column, values: dict, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def axis_color(axes: Column) -> Column:
    """Integer mean of the colours of the known axes as ``#rrggbb``."""
    known = F.filter(F.coalesce(axes, F.array().cast("array<string>")), lambda x: x.isin(*AXIS_RGB))
    part = lambda i: F.floor(F.aggregate(F.transform(known, lambda x: lookup(x, {k: v[i] for k, v in AXIS_RGB.items()}, 0)), F.lit(0), lambda a, x: a + x) / F.greatest(F.size(known), F.lit(1))).cast("int")
    return F.when(F.size(known) == 0, NO_AXIS_COLOR).otherwise(F.format_string("#%02x%02x%02x", part(0), part(1), part(2)))
