"""Best representative of each duplicate group: field-by-field survivorship.

One aggregation over the group key; for every attribute the extremum of a composite struct
``(usable, trust, content, recency, record id)`` names the record that supplies the value. The struct is stored
with its parts negated and ``min`` is taken, so that "smaller id wins" and "larger trust wins" are one ordering;
that is the maximum of the composite seen from the other side. Partial aggregation makes a group that holds a
third of all rows one row per task. The extremum is idempotent: records delivered again need no de-duplication,
and whether a group has two or more records is ``min(id) <> max(id)``.

Edge cases: null or blank ids and deleted records take no part; records without any name have no group; a value
that is null, blank, without letters or digits or a placeholder is never chosen, and a field without any usable
value gives no row; equal candidates are decided by the smaller id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.ids import canonical_id, newest_first

#: Entries that stand for "nothing known", compared in lower case without outer punctuation.
PLACEHOLDERS = (
    "n/a", "na", "n.a", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "empty", "tbd", "tba", "todo", "not available", "not applicable", "to be determined", "to be defined", "unspecified", "pending", "xxx",
    "不明", "なし", "無し", "無", "未記入", "未入力", "未定", "未設定", "該当なし", "記載なし", "未詳", "不詳", "空欄", "ｎ／ａ",
    "无", "未知", "不详", "暂无", "待定", "未填写", "未填", "没有", "待补充", "空",
)


@dataclass(frozen=True)
class Attribute:
    name: str
    array: bool = False


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def usable(trimmed: Column) -> Column:
    core = F.lower(F.regexp_replace(trimmed, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.coalesce((core != "") & ~core.isin(*PLACEHOLDERS), F.lit(False))


def clean_value(c: Column, array: bool) -> Column:
    """The usable value, trimmed, or null; of an array its distinct usable entries."""
    if not array:
        t = strip(c)
        return F.when(usable(t), t)
    kept = F.array_distinct(F.filter(F.transform(c, strip), usable))
    return F.when(F.size(kept) > 0, kept)


@F.pandas_udf(T.StringType())
def _fold(names: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        return "".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold()).split())

    return names.map(one, na_action="ignore")


#: So that a filter on the result is not pushed below it, where it would be computed a second time.
_fold_once = _fold.asNondeterministic()


def folded_name(c: Column) -> Column:
    """Equal for names that differ in letter case, width or spacing only; null if nothing is left.

    Names in ASCII, the most, stay in the JVM; only the others go through the Unicode tables in Python.
    """
    plain = c.rlike(r"^[\x00-\x7f]*$")
    folded = F.when(plain, F.regexp_replace(F.lower(c), r"\s+", "")).otherwise(_fold_once(F.when(~plain, c)))
    return F.when(folded != "", folded)


def concept_groups(concepts: DataFrame, trust: DataFrame, keep: Sequence[str] = ("definition", "four_axis", "context_quotes", "source_papers")) -> DataFrame:
    """Live concept records: group key ``g``, ``rid``, ``trust``, ``extraction_date`` and the columns of ``keep``.

    Everything else is projected away first, so columns of any other name can't clash.
    """
    ranks = trust.select(_provenance("provenance").alias("p"), F.col("trust").cast("int").alias("trust")).groupBy("p").agg(F.max("trust").alias("trust"))
    rows = concepts.where(F.col("deleted_at").isNull()).select(
        canonical_id("concept_id").alias("rid"), _provenance("provenance").alias("p"), folded_name(F.col("en_name")).alias("en_key"), folded_name(F.col("jp_name")).alias("jp_key"), "extraction_date", *keep
    )
    key = F.when(F.col("en_key").isNotNull(), F.concat(F.lit("e:"), "en_key")).otherwise(F.concat(F.lit("j:"), "jp_key"))
    return (
        rows.withColumn("g", key).where(F.col("rid").isNotNull() & F.col("g").isNotNull())
        .join(ranks, "p", "left")
        .select("g", "rid", F.coalesce("trust", F.lit(0)).alias("trust"), "extraction_date", *keep)
    )


def _provenance(c: str) -> Column:
    return F.regexp_replace(F.lower(strip(F.col(c))), r"[\s\-]+", "_")


def survivors(records: DataFrame, attributes: Sequence[Attribute], group: str = "g", record_id: str = "rid", trust: str = "trust", recency: str = "extraction_date", with_values: bool = True) -> DataFrame:
    """One row per group of two or more records: ``group_id`` and per attribute ``<name>`` and ``<name>_from``.

    ``with_values=False`` leaves the values out, so that only ids and sort keys are shuffled.
    """
    aggs = []
    projected = [F.col(group).alias("g"), F.col(record_id).alias("rid"), F.col(trust).alias("t"), newest_first(recency).alias("age")]
    for i, a in enumerate(attributes):
        projected.append(clean_value(F.col(a.name), a.array).alias(f"v{i}"))
    rows = records.select(*projected)
    for i, a in enumerate(attributes):
        v = F.col(f"v{i}")
        content = F.size(v) if a.array else F.length(v)
        key = [v.isNull().alias("empty"), (-F.col("t")).alias("t"), (-content).alias("c"), F.col("age"), F.col("rid")]
        aggs.append(F.min(F.struct(*key, *([v.alias("v")] if with_values else []))).alias(f"s{i}"))
    out = rows.groupBy("g").agg(F.min("rid").alias("group_id"), F.max("rid").alias("last_id"), *aggs).where("group_id <> last_id")
    cols = [F.col("group_id")]
    for i, a in enumerate(attributes):
        s = F.col(f"s{i}")
        cols.append(F.when(~s["empty"], s["rid"]).alias(f"{a.name}_from"))
        if with_values:
            cols.append(s["v"].alias(a.name))
    return out.select(*cols)


def suppliers(wide: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """``(group_id, field, concept_id)`` in long form from :func:`survivors`."""
    parts = [F.struct(F.lit(a.name).alias("field"), F.col(f"{a.name}_from").alias("concept_id")) for a in attributes]
    return wide.select("group_id", F.inline(F.array(*parts))).where(F.col("concept_id").isNotNull())
