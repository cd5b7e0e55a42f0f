"""Splitting, packing and mixing."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import mixing, packing, queries, splitting
from weftline.llm.tokens import PATTERN, load


def _check_pieces(tok, data, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
    for (start, end, tokens, _), nxt in zip(pieces, [*pieces[1:], None]):
        assert tok.count(data[start:end].decode()) <= min(limit, tokens + 2 if tokens < limit else limit)
        if nxt:
            assert start < nxt[0] <= end and nxt[1] > end
            shared = tok.count(data[nxt[0] : end].decode())
            assert shared <= overlap + 2


TEXTS = [
    "One sentence here. Another one follows, with a clause; and more! " * 60,
    "格付機関は、支払履歴を統合する。" * 80,
    "x" * 5000,
    "あ" * 2000,
    "para one.\n\npara two is longer, it has words.\r\n\r\n<p>markup</p>\n" * 40,
    "数値 3.5 と 1,000 件。" * 90 + "🙂" * 300,
    " \n" * 3000,
    "don't we'll I've " * 300,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(100, 16), (64, 0), (300, 40)])
def test_pieces(text, limit, overlap):
    tok, data = load(), text.encode()
    pieces = splitting.plan(text, tok, limit, overlap)
    if tok.count(text) > limit:
        _check_pieces(tok, data, pieces, limit, overlap)
        if overlap == 0:
            assert b"".join(data[s:e] for s, e, *_ in pieces) == data
    # The same text in ranges with halos: the same total, and pieces that hold as well.
    old, splitting.RANGE_BYTES = splitting.RANGE_BYTES, 700
    try:
        p = splitting.Planner(limit, overlap)
        for r in range(0, len(data), 700):
            _, table = splitting.range_table(data[max(0, r - splitting.BEFORE) : r], data[r : r + 700], data[r + 700 : r + 700 + splitting.HALO], tok)
            p.feed(splitting.np.frombuffer(table, splitting.np.uint8).reshape(3, -1))
        out = p.finish()
    finally:
        splitting.RANGE_BYTES = old
    assert abs(p.total - tok.count(text)) <= len(data) // 700 + 2
    if tok.count(text) > limit + len(data) // 700 + 2:
        _check_pieces(tok, data, out, limit, overlap)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_cuts_lie_between_pretokens(text):
    import regex

    points = splitting._codepoints(text)
    starts = {m.start() for m in regex.finditer(PATTERN, text)}
    assert len(points) == len(text)
    assert set(splitting.np.flatnonzero(splitting.safe_cuts(points)).tolist()) <= starts | {0} if len(points) else True


def test_boundaries_are_preferred():
    tok = load()
    text = "\n\n".join("Some words make this paragraph long enough to matter here. It has two sentences." for _ in range(30))
    for start, end, *_ in splitting.plan(text, tok, 100, 0)[:-1]:
        assert text[:end].endswith("\n\n") or text[end:].startswith("\n\n")


def test_split_documents(spark):
    rows = [(1, TEXTS[0], "a"), (2, "short", "b"), (3, None, "c"), (4, "", "d"), (5, TEXTS[3], "e"), (6, TEXTS[0], "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    plan = splitting.split_documents(docs, 100, 16)
    assert {r.id for r in plan.select("id").distinct().collect()} == {1, 5, 6}
    by = defaultdict(list)
    for r in plan.orderBy("id", "piece").collect():
        by[r.id].append((r.start, r.end, r.tokens, r.shared))
    for i, text in ((1, TEXTS[0]), (5, TEXTS[3]), (6, TEXTS[0])):
        _check_pieces(load(), text.encode(), by[i], 100, 16)
    assert by[1] == by[6]
    for r in splitting.with_text(docs, plan).collect():
        assert r.text == dict(zip((1, 5, 6), (TEXTS[0], TEXTS[3], TEXTS[0])))[r.id].encode()[r.start : r.end].decode()
    assert splitting.split_documents(docs.limit(0), 100, 16).count() == 0


def test_split_files(spark, tmp_path):
    big = (TEXTS[0] + TEXTS[1]) * 20
    (tmp_path / "big.txt").write_text(big, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    rows = splitting.split_files(spark, [str(tmp_path / "big.txt"), str(tmp_path / "empty.txt")], 1000, 50).orderBy("piece").collect()
    _check_pieces(load(), big.encode(), [(r.start, r.end, r.tokens, r.shared) for r in rows], 1000, 50)


@pytest.mark.parametrize(("part_ranges", "range_bytes"), [(3, 2000), (1, 6000), (50, 2000)])
@pytest.mark.parametrize("overlap", [0, 50])
def test_split_files_in_parts(spark, tmp_path, part_ranges, range_bytes, overlap):
    """A file in many parts, planned side by side, named by its address: pieces follow one another over the seams."""
    big = (TEXTS[0] + TEXTS[1] + "\n\n" + TEXTS[4]) * 6
    (tmp_path / "big.txt").write_text(big, encoding="utf-8")
    rows = splitting.split_files(spark, [f"file://{tmp_path}/big.txt"], 400, overlap, range_bytes=range_bytes, part_ranges=part_ranges).collect()
    rows.sort(key=lambda r: (r.part, r.piece))
    assert len({r.part for r in rows}) == -(-len(big.encode()) // (part_ranges * range_bytes))
    _check_pieces(load(), big.encode(), [(r.start, r.end, r.tokens, r.shared) for r in rows], 400, overlap)
    shared = [b.shared for b in rows[1:]]
    assert not overlap and not any(shared) or min(shared) >= 0.5 * overlap and max(shared) <= overlap


def test_p10_found(spark, small):
    import duckdb

    tok = load()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' WHERE text IS NOT NULL").fetchall()
    assert {r.doc_id for r in queries.p10_found(spark, small).collect()} == {i for i, t in rows if tok.count(t) > 1024}


# ------------------------------------------------------------ packing


def test_best_fit():
    rnd = random.Random(2)
    sizes = sorted((rnd.randrange(0, 101) for _ in range(900)), reverse=True)
    dup, src = [rnd.choice([None, *"abcdefgh"]) for _ in sizes], [rnd.choice([None, "s", "t"]) for _ in sizes]
    where = packing.best_fit(sizes, packing.conflict_masks(dup), packing.conflict_masks(src), 100)
    bins = defaultdict(list)
    for i, b in enumerate(where):
        bins[b].append(i)
    for held in bins.values():
        assert sum(sizes[i] for i in held) <= 100
        assert max(Counter(dup[i] for i in held if dup[i]).values(), default=1) == 1
    most = max(Counter(d for d in dup if d).values())
    assert len(bins) <= 1.03 * max(most, -(-sum(sizes) // 100)) + 1


def test_best_fit_takes_the_tightest():
    assert packing.best_fit([60, 50, 40], [0, 0, 0], [0, 0, 0], 100) == [0, 1, 0]
    assert packing.best_fit([60, 50, 40], [1, 0, 1], [0, 0, 0], 100) == [0, 1, 1]
    assert packing.best_fit([60, 50, 40], [1, 1, 1], [0, 0, 0], 100) == [0, 1, 2]
    assert packing.best_fit([60, 50, 40], [0, 0, 0], [1, 1, 1], 100) == [0, 1, 0]


def test_best_fit_looks_at_all_bins_for_another_source():
    # 70 tight bins hold the source; a looser one is free of it.
    assert packing.best_fit([60] * 70 + [50, 40], [0] * 72, [1] * 70 + [2, 1], 100)[-1] == 70
    # So for many copies: 40 tight bins hold their source, 40 looser ones don't.
    where = packing.best_fit([60] * 40 + [55] * 40 + [30] * 50, [0] * 80 + [1] * 50, [1] * 40 + [2] * 40 + [1] * 50, 100)
    assert set(where[80:120]) == set(range(40, 80)) and set(where[120:]) < set(range(40))


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_step_by_step(seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(0, 101), rnd.choice([None, *"abcdef"]), rnd.choice([None, *"stuvwx"])) for _ in range(300)]
    rows += [(n, f"copy{n}", rnd.choice("stuvw")) for n in (5, 20, 45) for _ in range(60)]
    rows.sort(key=lambda r: (-r[0], r[1] or ""))
    sizes, dup, src = zip(*rows)
    where = packing.best_fit(sizes, packing.conflict_masks(dup), packing.conflict_masks(src), 100)
    room, held = {}, defaultdict(set)
    for size, d, s, b in zip(sizes, dup, src, where):
        fits = [x for x in room if room[x] >= size and not (d and ("d", d) in held[x])]
        best = [x for x in fits if not (s and ("s", s) in held[x])] or fits
        assert b in best and room[b] == min(room[x] for x in best) if fits else b not in room
        room[b] = room.get(b, 100) - size
        held[b] |= {("d", d), ("s", s)}


def test_many_copies_of_one_text():
    sizes = [10] * 40_000
    where = packing.best_fit(sizes, [1] * 20_000 + [0] * 20_000, [2] * 40_000, 2048)
    assert len(set(where[:20_000])) == 20_000 and len(set(where)) == 20_000
    mixed = packing.best_fit([60] * 300 + [10] * 300, [0] * 300 + [1] * 300, [0] * 600, 100)
    assert len(set(mixed[300:])) == 300 and len(set(mixed)) == 300


def test_containers(spark):
    words = "alpha beta gamma delta. "
    rows = [(i, words * (i % 23 + 1), f"s{i % 3}") for i in range(200)] + [(900, words * 400, None), (901, None, "s"), (902, "", "s"), (903, words * 5, "x"), (904, words * 5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source_id string").withColumns({c: F.lit(1) for c in ("id", "piece", "tokens", "cluster", "shard", "container_id")})
    got = packing.pack(packing.items(docs, 128), 128).collect()
    tok = load()
    texts = {i: t for i, t, _ in rows}
    assert {r.id for r in got} == set(texts) - {901}
    by, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.container_id].append(r)
        pieces[r.id].append((r.start, r.end))
    for held in by.values():
        assert sum(tok.count(texts[r.id].encode()[r.start : r.end].decode()) for r in held) <= 128
        assert len({texts[r.id] for r in held}) == len(held)
    for i, ranges in pieces.items():
        assert b"".join(texts[i].encode()[a:b] for a, b in sorted(ranges)) == texts[i].encode()
        assert len(ranges) == 1 or tok.count(texts[i]) > 128
    assert packing.pack(packing.items(docs, 128), 128).collect() is not None
    assert packing.pack(packing.items(docs.limit(0), 128), 128).count() == 0


def test_containers_are_full(spark, small):
    r = queries.p8_fill(spark, small).first()
    assert r.fullest <= 2048 and r.fill > 0.9


# ------------------------------------------------------------ mixing


def test_route():
    goals = [mixing.Target("a", 0.5, 1), mixing.Target("b", 0.3, 3), mixing.Target("c", 0.1, 2), mixing.Target("none", 0.1, 9)]
    patterns = {("a",): 1000, ("b",): 100, ("a", "b"): 50, ("b", "c"): 40, ("c",): 10}
    flow, size = mixing.route(patterns, goals)
    got = Counter()
    used = Counter()
    for (p, layer, s), n in flow.items():
        assert s in p and layer < min({"a": 1, "b": 3, "c": 2}[x] for x in p)
        got[s] += n
        used[p, layer] += n
    assert all(n <= patterns[p] for (p, _), n in used.items())
    for g in goals[:3]:
        assert got[g.source] == int(size * g.share / 0.9)
    assert not any(layer and used[p, layer - 1] < patterns[p] for p, layer in used)
    assert mixing.route(patterns, goals, 90)[1] == 90
    assert mixing.route({}, goals) == ({}, 0)


def test_mixture(spark):
    rnd = random.Random(4)
    rows = [(i, "word " * rnd.randrange(1, 60) + str(i), rnd.choice(["A", " a", "b ", "B-x", "other", None])) for i in range(600)]
    rows += [(1000 + i, rows[i][1], "B x") for i in range(30)] + [(5000, None, "a"), (5001, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "s", "digest", "n", "pattern", "use", "tokens")})
    mix = spark.createDataFrame([("a", 0.6, 1), ("b_x", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(docs, mix)
    got = chosen.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(docs, mix)[0].collect()))
    text = {i: t for i, t, _ in rows}
    names = defaultdict(set)
    for _, t, s in rows:
        if s:
            names[t].add(s.strip().lower().replace("-", "_").replace(" ", "_"))
    uses = Counter(text[r.doc_id] for r in got)
    own = {i: s.strip().lower().replace("-", "_").replace(" ", "_") for i, _, s in rows if s}
    assert all(own[r.doc_id] == r.source for r in got)  # a use is named by a document of its source
    most = {"a": 1, "b_x": 3}
    for r in got:
        assert r.source in names[text[r.doc_id]] and uses[text[r.doc_id]] <= most[r.source]
    share = {r.source: r.actual_share for r in report.collect()}
    assert share["absent"] == 0 and abs(share["a"] - 0.6 / 0.9) < 0.02 and abs(share["b_x"] - 0.3 / 0.9) < 0.02
    none = mixing.mixture(docs.limit(0), mix)
    assert none[0].count() == 0 and none[1].count() == 3


def test_p9_shares(spark, small):
    rows = queries.p9_shares(spark, small).collect()
    have = sum(r.target_share for r in rows if r.uses)
    total = sum(r.tokens for r in rows)
    chosen = queries.p9_mixture(spark, small)
    largest = max(r.tokens for r in chosen.collect())
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", mixing.source_name("source").alias("own"))
    assert chosen.join(docs, "doc_id").where("own IS DISTINCT FROM source").count() == 0
    assert all(abs(r.actual_share - (r.target_share / have if r.uses else 0)) < largest / total + 0.01 for r in rows)
    assert all(r.most_uses <= r.max_repeats for r in rows)
