import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import rules, text


def pack(doc, size, least):
    """Paragraphs packed into chunks, written out step by step."""
    done, cur, n = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", doc)):
        if not p:
            continue
        if len(p) > size:
            if cur:
                done.append("\n\n".join(cur))
                cur, n = [], 0
            part, m = [], 0
            for s in re.split(r"(?<=[.!?。！？])\s+", p):
                if m + len(s) > size and part:
                    done.append(" ".join(part))
                    part, m = [], 0
                part.append(s)
                m += len(s)
            if part:
                done.append(" ".join(part))
        elif n + len(p) > size and cur:
            done.append("\n\n".join(cur))
            cur, n = [p], len(p)
        else:
            cur.append(p)
            n += len(p)
    if cur:
        done.append("\n\n".join(cur))
    out = []
    for c in done:
        if len(c) < least and out:
            out[-1] += "\n\n" + c
        else:
            out.append(c)
    return out


def test_chunks_match_brute_force(spark):
    rnd = random.Random(1)
    docs = ["", "   \n\n ", "x" * 30, "x" * 31, "短い。\n\n" + "長い文。 " * 20, "a.b c. d! e"]
    for _ in range(300):
        docs.append("".join(rnd.choice(["word ", "文章", "。", ". ", "! ", "\n\n", "\n \n", "long" * 6]) for _ in range(rnd.randrange(60))))
    got = spark.createDataFrame(list(enumerate(docs)), "i int, t string").select("i", text.chunks("t", 30, 8).alias("c")).collect()
    for r in got:
        assert r.c == pack(docs[r.i], 30, 8), docs[r.i]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab。. \n", max_size=80), min_size=1, max_size=20))
def test_chunks_keep_every_character(spark, docs):
    got = spark.createDataFrame(list(enumerate(docs)), "i int, t string").select("i", text.chunks("t", 20, 5).alias("c")).collect()
    for r in got:
        assert re.sub(r"\s", "", "".join(r.c)) == re.sub(r"\s", "", docs[r.i])


def test_names_and_similarity(spark):
    rows = [("報告 書(最終)__v2", "Ａ、 b"), ("_" * 90 + "x", "same!"), ("a" * 79 + "_b", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(text.sanitize_source_id("a"), text.normalize_text("b"), text.string_similarity("b", F.lit("same")), text.string_similarity("b", F.lit("評価制度"))).collect()
    assert [r[0] for r in got] == ["報告_書_最終_v2", "x", "a" * 79]
    assert [r[1] for r in got] == ["ａ b", "same", ""]
    assert got[1][2] == 1.0 and got[2][2] == 0.0


@pytest.mark.parametrize(
    ("h", "t", "r", "mean", "tier"),
    [(0, 0, 0, 0.5, 1), (0, 0, 1, 0.63, 0), (0, 1, 0, 0.6, 1), (0, 1, 1, 0.73, 0), (1, 0, 0, 0.33, 2), (1, 0, 1, 0.47, 1), (1, 1, 0, 0.43, 1), (1, 1, 1, 0.57, 1)],
)
def test_transferability_outcomes(spark, h, t, r, mean, tier):
    d = " ".join(["禁止"] * h + ["開示"] * t + ["救済"] * r) or "none"
    row = spark.range(1).select(*[c.alias(k) for k, c in rules.transferability(F.lit(d)).items()]).first()
    assert (row.transferability_score, row.recommendation) == (mean, rules.TIERS[tier])


def test_rules_on_missing_values(spark):
    df = spark.createDataFrame([(None, None), ("", []), ("データ data policy", ["ガバナンス", "データフロー"])], "d string, a array<string>")
    s = rules.axis_scores(F.coalesce("d", F.lit("")), F.col("a"))
    got = df.select(rules.dominant_axis(s).alias("x"), rules.axis_color(F.col("a")).alias("c"), s["data_flow"].alias("f")).collect()
    assert [r.x for r in got] == ["governance", "governance", "data_flow"]
    assert got[0].c == rules.NO_AXIS_COLOR and got[2].c == "#8e7283" or got[2].c.startswith("#")
    assert got[2].f == 1.0
