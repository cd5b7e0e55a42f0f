"""Orphans, hierarchies, graph, merges and similarity joins on small hand-made tables."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.text import normalize_text  # noqa: F401
from weftline.operators import dedup, forest, graph, hierarchy, maintain, orphans, ranking
from weftline.session import cut_lineage

T0 = dt.datetime(2024, 1, 15)
DAY = dt.timedelta(days=1)


def test_orphans(spark):
    con = spark.createDataFrame(
        [("a ", T0, None, "x"), ("A", T0 + 40 * DAY, None, "x"), ("B", T0, T0 + DAY, None), ("late", T0 + 90 * DAY, None, None), (None, T0, None, None), (" ", T0, None, None)],
        "concept_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string",
    )
    edges = spark.createDataFrame(
        [("A-B", "a", "B", T0 + 2 * DAY, 1), ("A-B", "A", " b", T0 + 60 * DAY, 2), ("A-LATE", "A", "late", T0, 3), ("A-GONE", "A", "gone", T0, 4), ("A-", "A", None, T0, 5), ("-", " ", "\t", T0, 6), ("A-NULL", "A", "gone", None, 7)],
        "id string, source string, target string, created_at timestamp_ntz, refs int",
    )
    refs = orphans.references(orphans.ReferenceSet("edges", edges, "id", "created_at", ("source", "target")))
    state = orphans.apply_deltas(orphans.reference_deltas(refs), orphans.existence(con, "concept_id", "loaded_at", "deleted_at"))
    got = {tuple(r) for r in orphans.orphan_report(refs, state).collect()}
    assert got == {
        ("edges", "2024-01", "A-B", "target", "B", "deleted"), ("edges", "2024-01", "A-LATE", "target", "LATE", "late"),
        ("edges", "2024-01", "A-GONE", "target", "GONE", "missing"), ("edges", None, "A-NULL", "target", "GONE", "missing"),
    }
    # Deltas are additive: taking the references away again, or loading the record, ends the case.
    arrived = orphans.existence(spark.createDataFrame([("gone", T0 - DAY, None)], "concept_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"), "concept_id", "loaded_at", "deleted_at")
    assert "GONE" not in {r.key for r in orphans.suspects(orphans.apply_deltas(state, arrived)).collect()}
    assert orphans.suspects(orphans.apply_deltas(state, orphans.reference_deltas(refs, -1))).count() == 0
    empty = orphans.references(orphans.ReferenceSet("edges", edges.limit(0), "id", "created_at", ("source", "target")))
    assert orphans.orphan_report(empty, orphans.apply_deltas(orphans.reference_deltas(empty))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_orphans_in_batches(spark, seed):
    """Loads, deletions and deliveries again, split and ordered at random, give what all at once give."""
    rnd = random.Random(seed)
    keys = [f"K{i}" for i in range(12)]
    con = [(rnd.choice(keys), T0 + rnd.randrange(60) * DAY, T0 if rnd.random() < 0.3 else None) for _ in range(25)]
    con += con[:6]
    ends = [(keys[i % 12], rnd.choice([*keys, "GONE", None])) for i in range(40)]
    edges = [(f"{s}-{t}", s, t, T0 + rnd.randrange(60) * DAY if rnd.random() < 0.9 else None) for s, t in ends]
    edges += [(*e[:3], T0) for e in edges[:5]] + edges[5:10]
    rnd.shuffle(con)
    rnd.shuffle(edges)
    con_type, edge_type = "concept_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz", "id string, source string, target string, created_at timestamp_ntz"

    def refs_of(rows):
        return orphans.references(orphans.ReferenceSet("edges", spark.createDataFrame(rows, edge_type), "id", "created_at", ("source", "target")))

    def existing(rows, state=None):
        return orphans.existence(spark.createDataFrame(rows, con_type), "concept_id", "loaded_at", "deleted_at", state)

    whole = orphans.apply_deltas(orphans.reference_deltas(refs_of(edges)), existing(con))
    expect = {tuple(r) for r in orphans.orphan_report(refs_of(edges), whole).collect()}
    state = known = None
    cuts = lambda rows: [0, *sorted(rnd.sample(range(len(rows)), 2)), len(rows)]
    for (a, b), (x, y) in zip(itertools.pairwise(cuts(edges)), itertools.pairwise(cuts(con))):
        refs = refs_of(edges[a:b])
        refs = refs.withColumn("seen", F.lit(False)) if known is None else orphans.news(refs, known)
        parts = [orphans.reference_deltas(refs), existing(con[x:y], state)]
        state = spark.createDataFrame(orphans.apply_deltas(*([state] if state is not None else []), *parts).collect(), whole.schema)
        known = spark.createDataFrame(orphans.earliest(*([known] if known is not None else []), refs).collect(), orphans.earliest(refs).schema)
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in orphans.orphan_report(known, state).collect()} == expect


def _brute_forest(parent):
    out = {}
    for n in set(parent) | set(parent.values()):
        path, seen = [n], {n}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        out[n] = ("CYCLE", -1, "") if path[-1] in parent else (path[-1], len(path) - 1, ">".join(reversed(path)))
    return out


@pytest.mark.parametrize(("kind", "spacing"), [("random", 4), ("chain", 3), ("star", 4), ("cycles", 4), ("cycles", 10**9), ("empty", 4)])
def test_hierarchies(spark, kind, spacing):
    rnd = random.Random(7)
    parent = {
        "random": {f"N{i}": f"N{rnd.randrange(i)}" for i in range(1, 300)},
        "chain": {f"N{i}": f"N{i + 1}" for i in range(150)},
        "star": {f"N{i}": "ROOT" for i in range(500)},
        "cycles": {"A": "B", "B": "C", "C": "A", "D": "A", "E": "D", "S": "S", "X": "Y", **{f"R{i}": f"R{(i + 1) % 40}" for i in range(40)}, "T": "R3"},
        "empty": {},
    }[kind]
    rows = [(c, p, T0 + DAY) for c, p in parent.items()] * 2 + [(c, "ZZZ", T0) for c in list(parent)[:5] if kind != "empty"]
    links = spark.createDataFrame(rows, "child string, parent string, at timestamp_ntz")
    if kind != "empty":
        parent["ZZZ"] = parent.pop("ZZZ", None)
        del parent["ZZZ"]
    expect = _brute_forest(parent)
    if rows:
        expect["ZZZ"] = ("ZZZ", 0, "ZZZ")
    nodes = forest.hierarchies(forest.single_parent(links), spacing).collect()
    assert len(nodes) == len(expect)
    assert {r.node_id: (r.root_id, r.depth, r.path) for r in nodes} == expect


def test_parent_ties_and_descendants(spark):
    e = spark.createDataFrame(
        [("a", "p", "Is-A", T0), ("a", "q", "sub_sumption", T0 + DAY), ("a", "b", "IS A", T0 + DAY), ("b", "c", "subsumption", None), ("c", "x", "causal", T0), (None, "x", "is-a", T0), ("x", " ", "is-a", T0)],
        "source string, target string, type string, created_at timestamp_ntz",
    )
    n = forest.hierarchies(forest.single_parent(forest.subsumption_links(e)))
    assert {(r.node_id, r.path) for r in n.collect()} == {("A", "C>B>A"), ("B", "C>B"), ("C", "C"), ("P", "P"), ("Q", "Q")}
    assert {tuple(r) for r in forest.descendants(n).collect()} == {("C", "B", 1), ("C", "A", 2), ("B", "A", 1)}
    assert {tuple(r) for r in forest.descendant_counts(n).collect()} == {("A", 0, 0), ("B", 1, 1), ("C", 2, 2), ("P", 0, 0), ("Q", 0, 0)}


def test_gaps_and_cap(spark):
    rows = [("A", "B"), ("B", "C"), ("C", "A"), ("B", "D"), ("D", "B"), ("E", "E"), ("F", None)] + [("HUB", f"L{i:02d}") for i in range(16)]
    pairs = graph.undirected(spark.createDataFrame(rows, "source string, target string"))
    found = graph.gaps(pairs)
    assert found.where("b = 'B'").count() == 2 and found.where("b = 'HUB'").count() == 120
    assert graph.gaps(pairs, 15).where("b = 'HUB'").count() == 0
    adj = {tuple(r) for r in graph.adjacency(pairs).collect()}
    assert all((y, x) in adj for x, y in adj)
    direct = {(r.a, r.b) for r in pairs.collect()}
    assert not {(r.a, r.c) for r in found.collect()} & direct
    scored = found.withColumn("score", F.lit(1.0)).withColumn("cross_country", F.lit(True))
    top = ranking.diversify(scored, 5, 50).collect()
    assert max(len(list(g)) for _, g in itertools.groupby(sorted(r.b for r in top))) == 5
    assert ranking.diversify(scored, 5, 50).collect() == top


def _brute_merge(pairs, ids):
    gone = {}
    for _, a, b in sorted(pairs):
        if a != b and a in ids and b in ids and a not in gone and b not in gone:
            gone[b] = a
    out = {}
    for b in gone:
        x = b
        while x in gone:
            x = gone[x]
        out[b] = x
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merges_in_order(spark, seed):
    rnd = random.Random(seed)
    ids = [f"N{i:02d}" for i in range(40)]
    pairs = [(i, rnd.choice(ids), rnd.choice(ids)) for i in range(60)] + [(99, "N01", "GONE")]
    have = spark.createDataFrame([(i,) for i in ids], "id string")
    m = maintain.greedy_map(spark.createDataFrame(pairs, "ord int, a string, b string"), have)
    expect = _brute_merge(pairs, set(ids))
    assert {r.gone: r.kept for r in m.collect()} == expect
    con = spark.createDataFrame([(i, i.lower(), ["x"], [f"s{i}"], [f"q{i}"] * 2, rnd.sample(ids, 3)) for i in ids], "id string, en_name string, four_axis array<string>, source_papers array<string>, context_quotes array<string>, related_concepts array<string>")
    out = {r.id: r for r in maintain.apply_merges(con, m).collect()}
    assert set(out) == set(ids) - set(expect)
    for i, r in out.items():
        assert i not in r.related_concepts and not set(r.related_concepts) & set(expect)
        assert len(r.context_quotes) <= 5 and r.en_name == i.lower()
        assert set(r.source_papers) == {f"s{i}"} | {f"s{b}" for b, k in expect.items() if k == i}
    e = spark.createDataFrame([(a, b, "t") for _, a, b in pairs], "source string, target string, type string")
    ends = maintain.redirect(e, m).collect()
    assert all(r.source != r.target and not {r.source, r.target} & set(expect) for r in ends)


def test_long_chains_of_merges(spark, monkeypatch):
    """Each pair of a chain hangs on the one before it: they are decided in logarithmic steps."""
    cuts = []
    monkeypatch.setattr(maintain, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    n = 300
    pairs = [(i, f"N{i:03d}", f"N{i + 1:03d}") for i in range(n)] + [(n + i, f"N{3 * i:03d}", f"N{2 * i + 1:03d}") for i in range(40)]
    have = spark.createDataFrame([(f"N{i:03d}",) for i in range(n + 1)], "id string")
    m = maintain.greedy_map(spark.createDataFrame(pairs, "ord int, a string, b string"), have)
    assert {r.gone: r.kept for r in m.collect()} == _brute_merge(pairs, {f"N{i:03d}" for i in range(n + 1)})
    assert len(cuts) < 40


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_similar_names_is_exact(spark, threshold):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("ab評価c") for _ in range(rnd.randrange(1, 12))) for _ in range(120)}
    rows = [(i, w) for i, w in enumerate(sorted(words))] + [(900, "aab"), (901, "aab!"), (902, None), (903, "  ")]
    got = dedup.similar_names(dedup.name_classes(spark.createDataFrame(rows, "id int, name string"), "id", "name"), threshold).collect()

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    names = sorted(words | {"aab"})
    expect = {(a, b) for a, b in itertools.combinations(names, 2) if 1 - lev(a, b) / max(len(a), len(b)) >= threshold - 1e-12}
    assert {(r.x, r.y) for r in got} == expect


def test_similar_names_of_concepts(spark, small):
    from weftline.plans import discovery, registry

    n = discovery.concepts(spark, small).select(normalize_text(F.coalesce("en_name", F.lit(""))).alias("n")).where("n <> ''").groupBy("n").agg(F.count("*").alias("m")).collect()
    a, b = spark.createDataFrame(n).toDF("x", "members_x"), spark.createDataFrame(n).toDF("y", "members_y")
    s = 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))
    expect = {tuple(r) for r in a.crossJoin(b).where("x < y").where(s >= 0.6 - 1e-12).select("x", "y", F.round(s, 6), "members_x", "members_y").collect()}
    got = registry.queries()["concept_name_dups"](spark, small).collect()
    assert len(got) == len(expect) > 0 and {tuple(r) for r in got} == expect


def test_similar_classes_move_no_pairs(spark):
    """Pairs are found where two blocks meet and nothing is joined after; names may be longer than a machine word."""
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcd評") for _ in range(n)) for n in (3, 9, 40, 63, 64, 65, 66, 90, 127, 128, 129, 140, 260)]
    words = set(base)
    for w in base * 12:
        w = list(w)
        for _ in range(rnd.randrange(1, 2 + len(w) * 5 // 10)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "x", "評", "𠮷"])
        words.add("".join(w))
    words = sorted(words - {""})
    classes = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "norm string, members int")
    members = {w: 1 + i for i, w in enumerate(words)}
    a, b = classes.select(F.col("norm").alias("x")), classes.select(F.col("norm").alias("y"))
    s = 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))
    expect = {(r.x, r.y, r.s, members[r.x], members[r.y]) for r in a.crossJoin(b).where("x < y").where(s >= 0.6 - 1e-12).select("x", "y", s.alias("s")).collect()}
    for block in (10_000, 7):
        got = dedup.similar_classes(classes, 0.6, block)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        rows = [tuple(r) for r in got.collect()]
        assert "Join" not in plan and len(rows) == len(expect) > 300 and set(rows) == expect
    assert dedup.similar_classes(classes.limit(0), 0.6).count() == 0


def test_duplicates_are_scored_by_record(spark):
    kind = "id int, en_name string, jp_name string, definition string, concept_type string, country_tag string, four_axis array<string>"
    rnd = random.Random(3)
    rows = [(1, "credit score", None, "zzzz", "x", "US", None), (2, "Credit Score!", None, "rating of people", "policy", "CN", ["a", "b"]), (3, "credit scare", None, "rating of people", "policy", "CN", ["b", "a"]), (4, "credit scare", None, "Rating of people.", "policy", "CN", ["a", "b", "a"])]
    rows += [(10 + i, rnd.choice(["trust", "trusty", "truth", None]), rnd.choice(["信用", "信用度", "", None]), rnd.choice([None, "", "!", "one text", "one test", "other words here"]), rnd.choice(["p", "q", None]), rnd.choice(["CN", None]), rnd.choice([None, [], ["a"], ["a", "b"]])) for i in range(80)]
    df = spark.createDataFrame(rows, kind)
    from weftline.functions.similarity import structural_similarity
    from weftline.functions.text import string_similarity

    # Brute force over all pairs of records.
    a, b = df.select(*[F.col(c).alias(f"{c}_a") for c in df.columns]), df.select(*[F.col(c).alias(f"{c}_b") for c in df.columns])
    axes = lambda e: F.coalesce(f"four_axis_{e}", F.array().cast("array<string>"))
    name = F.greatest(string_similarity("en_name_a", "en_name_b"), string_similarity("jp_name_a", "jp_name_b"))
    overall = 0.5 * name + 0.3 * string_similarity("definition_a", "definition_b") + 0.2 * structural_similarity(F.col("concept_type_a"), F.col("concept_type_b"), F.col("country_tag_a"), F.col("country_tag_b"), axes("a"), axes("b"))
    expect = {(r.id_a, r.id_b): r.o for r in a.crossJoin(b).where("id_a < id_b").where((name >= 0.4) & (overall >= 0.6)).select("id_a", "id_b", F.round(overall, 6).alias("o")).collect()}
    members = {}
    for r in dedup.class_members(df).collect():
        members.setdefault(r.class_id, []).append(r.id)
    got = {}
    for r in dedup.duplicate_candidates(df).collect():
        assert (len(members[r.id_a]), len(members[r.id_b])) == (r.members_a, r.members_b)
        for i, j in itertools.combinations(members[r.id_a], 2) if r.id_a == r.id_b else itertools.product(members[r.id_a], members[r.id_b]):
            assert (min(i, j), max(i, j)) not in got
            got[min(i, j), max(i, j)] = round(r.overall, 6)
    assert got == pytest.approx(expect) and (2, 3) in got and (3, 4) in got and (1, 2) not in got


def test_heuristics(spark):
    kind = "struct<jp_name:string,en_name:string,definition:string,concept_type:string,sources:int>"
    cases = [
        (("信用制度", None, None, None, 0), ("地方信用制度", None, None, None, 0), ("B_is_a_A", 0.7)),
        (("x", "alpha", "uses betamax here", None, 0), ("y", "betamax", "", None, 0), ("A_is_a_B", 0.6)),
        (("x", "abc", None, "theory", 0), ("y", "abcd", None, "actor", 0), ("B_is_a_A", 0.4)),
        (("x", "q", None, "policy", 5), ("y", "r", None, "data_system", 3), ("B_is_a_A", 0.3)),
        ((None, None, None, None, None), (None, None, None, None, None), ("no_relation", 0.0)),
        (("同じ名前だ", "gamma", None, None, 0), ("同じ名前だ", "gammaray", None, None, 0), ("B_is_a_A", 0.7)),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    got = df.select("i", hierarchy.infer("a", "b").alias("v")).collect()
    for r in got:
        assert (r.v.relation, r.v.confidence) == cases[r.i][2], cases[r.i]


def test_assigned_ids_do_not_collide(spark):
    old = spark.createDataFrame([("SCS-0007",), ("odd",), (None,)], "concept_id string")
    got = [r.concept_id for r in dedup.assign_ids(spark.createDataFrame([(f"n{i}",) for i in range(30)], "n string"), "n", existing=old).orderBy("n").collect()]
    assert len(set(got)) == 30 and min(got) == "SCS-0008" and max(got) == "SCS-0037"
    assert [r.concept_id for r in dedup.assign_ids(spark.createDataFrame([("x",)], "n string"), "n").collect()] == ["SCS-0001"]


def test_dedup_keeps_first_and_caps_quotes(spark):
    rows = [(1, "Name ", None, "t1", ["p"], ["g"], [f"q{i}" for i in range(4)]), (2, "name", "x", "t2", ["p", "r"], None, [f"r{i}" for i in range(4)]), (3, None, "日本", "t3", None, None, None), (4, " ", "", "t4", None, None, None)]
    df = spark.createDataFrame(rows, "ord int, en_name string, jp_name string, concept_type string, source_papers array<string>, four_axis array<string>, context_quotes array<string>")
    got = {r.key: r for r in dedup.deduplicate(df, "ord", ("concept_type",), ("source_papers", "four_axis"), "context_quotes").collect()}
    assert set(got) == {"name", "日本"}
    assert got["name"].concept_type == "t1" and got["name"].source_papers == ["p", "r"] and got["name"].context_quotes == ["q0", "q1", "q2", "q3", "r0"]


def test_mentions(spark):
    names = spark.createDataFrame([(1, "alpha beta"), (2, "abc"), (3, "gamma"), (4, "GAMMA "), (5, None)], "id int, name string")
    texts = spark.createDataFrame([(1, "The Gamma ray of alpha beta"), (3, "gamma"), (7, None), (8, "ab"), (9, "alpha  beta")], "id int, text string")
    assert {tuple(r) for r in maintain.mentions(names, texts).collect()} == {(1, 4, "gamma"), (3, 4, "gamma")}


def test_manual_edges(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    have = spark.createDataFrame([("A", "B", "t")], "source string, target string, type string")
    manual = spark.createDataFrame([("k1", "B", "A", "t"), ("k1", "B", "C", "t"), ("k2", "C", "B", "u"), ("k2", "A", "X", "t")], "category string, source string, target string, type string")
    new, missing = maintain.add_manual_edges(have, manual, nodes)
    assert [(r.source, r.target, r.category, r.manual) for r in new.collect()] == [("B", "C", "k1", True)]
    assert [tuple(r) for r in missing.collect()] == [("A", "X", "X")]
    rel = maintain.add_related(spark.createDataFrame([("A", None), ("B", ["Z"])], "id string, related_concepts array<string>"), manual.select("source", "target"))
    assert {r.id: r.related_concepts for r in rel.collect()} == {"A": ["B", "X"], "B": ["Z", "A", "C"]}


def test_lookup_and_layout(spark):
    from weftline.operators import cooccurrence

    pairs = spark.createDataFrame([("b", "a"), ("c", "d")], "a string, c string")
    known = spark.createDataFrame([("a", "b", "known", 0.9)], "x string, y string, text string, confidence double")
    got = {(r.a, r.c): (r.hypothesis, r.confidence) for r in cooccurrence.lookup_hypotheses(pairs, known).collect()}
    assert got == {("b", "a"): ("known", 0.9), ("c", "d"): ("c × d", 0.5)}
    place = cooccurrence.circular_layout(spark.range(4), "id", 4).orderBy("id").collect()
    assert (round(place[0].x), round(place[0].y)) == (580, 250) and (round(place[1].x), round(place[1].y)) == (400, 430)


@pytest.mark.parametrize(("threshold", "cells", "block"), [(0.8, None, 4096), (0.3, 7, 20), (0.95, 1, 50), (-1.0, 3, 4096)])
def test_cosine_pairs_are_complete(spark, threshold, cells, block):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 8))
    x[100:] = x[:50] * rng.uniform(0.1, 9, (50, 1)) + 0.1 * rng.standard_normal((50, 8))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [], "x"), (903, [float("nan")] * 8, "x"), (None, x[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "id int, vec array<double>, cell string")
    got = {(r.id_a, r.id_b): r.similarity for r in dedup.cosine_pairs(df, threshold, cells=cells, block=block).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    expect = {(i, j) for i, j in itertools.combinations(range(150), 2) if s[i, j] >= threshold}
    assert set(got) == expect and all(abs(got[p] - s[p]) < 1e-9 for p in got)
    assert dedup.cosine_pairs(df.limit(0), threshold).count() == 0
    band = dedup.cosine_pairs(df, threshold, 0.99, cells=cells, block=block).collect()
    assert {(r.id_a, r.id_b) for r in band} == {p for p in expect if s[p] < 0.99}


def test_embeddings(spark):
    rows = [("A", "規則", "Rule", "x"), ("B", None, None, None), ("C", "", " ", "\u3000"), ("D", None, "ab", None), ("E", "規則", "Rule", "x")]
    got = {r.id: r.vec for r in dedup.embed(spark.createDataFrame(rows, "concept_id string, jp_name string, en_name string, definition string")).collect()}
    assert len(got) == 5 and all(len(v) == 64 for v in got.values())
    assert got["A"] == got["E"] and got["B"] == got["C"] and sum(got["B"]) == len("unknown") - 2 and sum(got["D"]) == 1


def test_mentions_agree(spark, small):
    """The automaton and the joins on rare characters find the same."""
    from weftline.plans import discovery

    c = discovery.concepts(spark, small)
    names = c.select("id", F.explode(F.array("en_name", "jp_name", "zh_name")).alias("name")).where("name IS NOT NULL")
    names = names.unionByName(spark.createDataFrame([("X1", "credit"), ("X2", "Credit "), ("X3", "abc"), ("X4", None), ("X5", "信用評価の")], "id string, name string"))
    texts = c.select("id", F.col("definition").alias("text")).unionByName(spark.createDataFrame([("T1", "CREDIT and 信用評価の credit"), ("T2", None), ("T3", ""), ("X2", "credit")], "id string, text string"))
    one = {tuple(r) for r in maintain.mentions(names, texts).collect()}
    assert one == {tuple(r) for r in maintain.mentions(names, texts, most=0).collect()} and ("T1", "X2", "credit") in one and ("X2", "X2", "credit") not in one
    assert maintain.mentions(names.limit(0), texts).count() == 0 and maintain.mentions(names, texts.limit(0)).count() == 0


@pytest.mark.parametrize("part", [1 << 22, 100])
def test_mentions_by_a_filter(spark, small, monkeypatch, part):
    """Neither names nor grams of texts are moved to the driver or written: what is shuffled stays near the input."""
    from weftline.plans import discovery

    monkeypatch.setattr(maintain, "SLICE", 50)
    c = discovery.concepts(spark, small)
    names = c.select("id", F.explode(F.array("en_name", "jp_name", "zh_name")).alias("name")).where("name IS NOT NULL")
    names = names.unionByName(spark.createDataFrame([("X1", "credit"), ("X2", "𠮷野家abcdef"), ("X3", "z" * 130), ("X4", "long name of 16c"), ("X5", "aaaaaaaa"), ("X6", "aaaa")], "id string, name string"))
    texts = c.select("id", F.col("definition").alias("text")).unionByName(spark.createDataFrame([("T1", "𠮷野家ABCDEF, credit" + "z" * 131 + "long name of 16c"), ("T2", "a" * 301), ("T3", "cred"), ("T4", "it zz")], "id string, text string"))
    got = maintain.mentions(names, texts, most=0, part=part)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "strategy=merge" in plan and "substring" not in plan
    one = {tuple(r) for r in got.collect()}
    assert one == {tuple(r) for r in maintain.mentions(names, texts).collect()}
    assert {("T1", "X1", "credit"), ("T1", "X2", "𠮷野家abcdef"), ("T1", "X3", "z" * 130), ("T1", "X4", "long name of 16c"), ("T2", "X5", "aaaaaaaa"), ("T2", "X6", "aaaa")} == {x for x in one if x[1].startswith("X") and x[0].startswith("T")}


@pytest.mark.parametrize("block", [3, 1000])
def test_wedges_of_hubs(spark, monkeypatch, block):
    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample(range(30), 2))) for _ in range(60)} | {(0, i) for i in range(1, 30)}
    side = spark.createDataFrame([(a, b) for p in pairs for a, b in (p, p[::-1])], "src int, dst int")
    got = [(r.p, r.bridge, r.q) for r in graph.wedges(side.join(graph.degrees(side), "src"), block).collect()]
    near = {b: {x for p in pairs for x in p if b in p} - {b} for b in range(30)}
    assert sorted(got) == sorted((p, b, q) for b in near for p, q in itertools.combinations(sorted(near[b]), 2))
