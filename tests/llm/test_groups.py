"""Survivorship, top N and connected components against brute force, with their edge cases."""

import datetime as dt
import random
import unicodedata
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, queries, survivorship, topn

NOW = dt.datetime(2024, 1, 1)
CONCEPT = "concept_id string, en_name string, jp_name string, definition string, four_axis array<string>, context_quotes array<string>, source_papers array<string>, provenance string, extraction_date timestamp_ntz, deleted_at timestamp_ntz, g string"


def _fold(s):
    return "".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s or "").casefold()).split())


def _value(v):
    t = (v or "").strip(" \t\r\n　\xa0")
    core = t.lower()
    while core and not core[0].isalnum():
        core = core[1:]
    while core and not core[-1].isalnum():
        core = core[:-1]
    return t if core and core not in survivorship.PLACEHOLDERS else None


def _brute_p1(rows, trust):
    groups = defaultdict(dict)
    for r in rows:
        if r["deleted_at"] is None and r["concept_id"] and r["concept_id"].strip():
            key = ("e", _fold(r["en_name"])) if _fold(r["en_name"]) else ("j", _fold(r["jp_name"])) if _fold(r["jp_name"]) else None
            if key:
                groups[key][r["concept_id"].strip().upper()] = r
    out = set()
    for members in groups.values():
        if len(members) < 2:
            continue
        for f in ("definition", "four_axis", "context_quotes", "source_papers"):
            best = []
            for i, r in members.items():
                if f == "definition":
                    c = len(_value(r[f]) or "")
                else:
                    c = len({_value(x) for x in r[f] or []} - {None})
                if c:
                    age = (r["extraction_date"] or dt.datetime(1, 1, 1)) - dt.datetime(1, 1, 1)
                    best.append((-trust.get((r["provenance"] or "").strip().lower(), 0), -c, -age, i))
            if best:
                out.add((min(members), f, min(best)[3]))
    return out


def test_p1_matches_brute_force(spark, small):
    con = duckdb.connect()
    cur = con.execute(f"SELECT concept_id, en_name, jp_name, definition, four_axis, context_quotes, source_papers, provenance, extraction_date, deleted_at FROM '{small}/concept.parquet'")
    names = [x[0] for x in cur.description]
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    trust = dict(con.execute(f"SELECT provenance, trust FROM '{small}/provenance_trust.parquet'").fetchall())
    got = queries.p1_found(spark, small).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r.group_id, r.field, r.concept_id) for r in got} == _brute_p1(rows, trust)


def test_p1_edges(spark):
    rows = [
        ("a1 ", "X  y", None, "long definition", ["q", "q", "N/A"], None, [], "LLM_V2 ", NOW, None, "clash"),
        ("A2", "ＸＹ", "z", "(none)", ["q", None, ""], ["　"], ["不明", "p"], "unheard", None, None, None),
        ("A2", "xy", "z", "(none)", ["q", None, ""], ["　"], ["不明", "p"], "unheard", None, None, None),
        ("A0", "xy", None, "d", None, None, None, "llm_v2", NOW, NOW, None),
        (None, "xy", None, "d", None, None, None, "llm_v2", NOW, None, None),
        ("B1", " ", "ｶﾞ", "d1", None, None, None, None, None, None, None),
        ("B2", None, "ガ", "d2", None, None, None, None, None, None, None),
        ("C1", None, None, "d", ["q"], ["q"], ["q"], "llm_v2", NOW, None, None),
    ]
    trust = spark.createDataFrame([("llm_v2", 3)], "provenance string, trust int")
    clash = spark.createDataFrame(rows, CONCEPT).withColumns({c: F.lit(1) for c in ("trust", "p", "rid", "en_key", "v0", "age", "group_id")})
    wide = survivorship.survivors(survivorship.concept_groups(clash, trust), queries.ATTRIBUTES)
    assert {tuple(r) for r in survivorship.suppliers(wide, queries.ATTRIBUTES).collect()} == {("A1", "definition", "A1"), ("A1", "four_axis", "A1"), ("A1", "source_papers", "A2"), ("B1", "definition", "B1")}
    empty = survivorship.concept_groups(spark.createDataFrame([], CONCEPT).drop("g"), trust)
    assert survivorship.survivors(empty, queries.ATTRIBUTES).count() == 0


def test_top_n_edges(spark):
    rows = [("g", float(i % 3), f"k{i:03d}", "x") for i in range(300)] + [(None, 9.0, "n", "x"), ("g", float("nan"), "nan", "x"), ("g", None, "none", "x"), ("g", 5.0, None, "x"), ("h", 1.0, "only", None)]
    df = spark.createDataFrame(rows, "grp string, s double, k string, rank string")
    got = topn.top_n(df, "grp", "s", "k", 3)
    assert [tuple(r) for r in got.orderBy("grp", "rank").collect()] == [("g", 2.0, "k002", 1), ("g", 2.0, "k005", 2), ("g", 2.0, "k008", 3), ("h", 1.0, "only", 1)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert topn.top_n(df.limit(0), "grp", "s", "k", 3).count() == 0
    late = spark.createDataFrame([("k", NOW, 5.0), ("k", NOW + dt.timedelta(1), None), (None, NOW, 1.0)], "k string, t timestamp_ntz, s double")
    assert [tuple(r)[2] for r in topn.latest_per_key(late, "k", "t").collect()] == [None]


def _brute_components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in up}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    rnd = random.Random(3)
    pairs = {
        "random": [(f"N{rnd.randrange(300):03d}", f"N{rnd.randrange(300):03d}") for _ in range(220)] + [(None, "N001"), ("N002", None), ("N009", "N009")],
        "chain": [(f"N{i:03d}", f"N{i + 1:03d}") for i in rnd.sample(range(200), 200)],
        "star": [("M", f"N{i:03d}") for i in range(500)] * 2 + [(f"N{i:03d}", "M") for i in range(50)],
        "empty": [],
    }[kind]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({c: F.lit(1) for c in ("u", "v", "m", "id", "group_id")})
    got = components.connected_components(df).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == _brute_components(pairs)


def test_p7_matches_brute_force(spark, small):
    pairs = duckdb.sql(f"SELECT upper(trim(concept_a.id, ' ' || chr(9))), upper(trim(concept_b.id, ' ' || chr(9))) FROM '{small}/merge_candidates.parquet' WHERE lower(trim(action)) = 'merge'").fetchall()
    assert {(r.concept_id, r.group_id) for r in queries.p7_found(spark, small).collect()} == _brute_components(pairs)
