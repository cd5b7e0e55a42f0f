"""Scanned text: made-up noise in the project's clean sources must be found and repaired."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from weftline.llm import scanned

SCHEMA = "source_id string, chunk_index int, text string, line_no int"


def _clean_lines(sf_dir, language):
    rows = duckdb.sql(f"SELECT source_id, text FROM '{sf_dir}/documents.parquet' WHERE text IS NOT NULL AND lower(lang) LIKE '{language}%' AND length(text) > 400").fetchall()
    return re.sub(r"\s+", " ", " ".join(t for _, t in rows))


def _noisy(text, width, seed, title, swaps):
    """Pages of lines with a title, rising page numbers, divided words and swapped characters; and what was done."""
    rnd = random.Random(seed)
    words = text.split(" ")
    lines, truth, cur, page = [], {}, "", 30

    def put(line, kind=None):
        lines.append(line)
        if kind:
            truth.setdefault(len(lines), set()).add(kind)

    for w in words:
        if len(cur) + len(w) > width and cur:
            if w.isalpha() and w.isascii() and len(w) > 7 and rnd.random() < 0.5:
                put(f"{cur} {w[:4]}-", "hyphen")
                cur = w[4:]
            else:
                put(cur)
                cur = w
            for seen, written in swaps:
                if rnd.random() < 0.03:
                    spots = [m.start() for m in re.finditer(written, lines[-1])]
                    spots = [s for s in spots if lines[-1][s - 1 : s].islower() and lines[-1][s + 1 : s + 3].islower()]
                    if spots:
                        s = rnd.choice(spots)
                        lines[-1] = lines[-1][:s] + seen + lines[-1][s + len(written) :]
                        truth.setdefault(len(lines), set()).add("misread")
            if len(lines) % 30 == 29:
                page += 1
                put(f"- {page} -", "page_number")
                put(title, "header")
        else:
            cur = f"{cur} {w}" if cur else w
    put(cur)
    return lines, truth


def test_found_in_made_up_scans(spark):
    text = _clean_lines("/root/testdata/sf0.01", "en")[:400_000]
    swaps = (("c", "e"), ("0", "o"), ("rn", "m"), ("ä", "a"))
    rows, truth = [], set()
    for s in range(4):
        lines, t = _noisy(text[s * 90_000 : (s + 1) * 90_000], 60, s, "A Running Title of Things", swaps)
        rows += [(f"src{s}", c // 50, "\n".join(lines[c : c + 50]), 9) for c in range(0, len(lines), 50)]
        truth |= {(f"src{s}", (n - 1) // 50, (n - 1) % 50 + 1, k) for n, ks in t.items() for k in ks}
    chunks = spark.createDataFrame(rows + rows[:3] + [(None, 1, "x", 1), ("src9", 0, None, 1), ("src9", 1, "", 1)], SCHEMA)
    model = scanned.learn(chunks)
    got = {tuple(r) for r in scanned.noise(chunks, model).collect()}
    by = defaultdict(lambda: [set(), set()])
    for x in truth:
        by[x[3]][0].add(x)
    for x in got:
        by[x[3]][1].add(x)
    for kind, (true, found) in by.items():
        both = len(true & found)
        assert both >= (0.8 if kind == "misread" else 0.9) * len(true), (  # rare words have no frequent neighbour here
            kind, len(true), len(found), both, list(true - found)[:5])
        assert both >= 0.9 * len(found), (kind, len(true), len(found), both, list(found - true)[:5])
    out = scanned.repaired(chunks, model).collect()
    assert not any("A Running Title" in r.text for r in out)
    joined = " ".join(r.text for r in sorted(out, key=lambda r: (r.source_id, r.block, r.paragraph)))
    original = Counter(w for s in range(4) for w in text[s * 90_000 : (s + 1) * 90_000].split())
    assert sum((Counter(joined.split()) & original).values()) > 0.97 * sum(original.values())
    assert joined.count("ä") < 0.3 * sum(r[2].count("ä") for r in rows)


def _topics(seed):
    rnd = random.Random(seed)
    paper, land = [["the", "form", "protection", "paper", "office", "clerk", "stamp", "desk"], ["cattle", "wheat", "barn", "plough", "soil", "crop", "sheep", "hay"]]
    lines = [" ".join(rnd.choice(topic) for _ in range(12)) for topic in (paper, land) for _ in range(900)]
    return rnd, lines


def _chunks(spark, lines, size=100):
    return spark.createDataFrame([("s", i, "\n".join(lines[i * size : i * size + size])) for i in range(-(-len(lines) // size))], "source_id string, chunk_index int, text string")


def _misread(spark, lines, model, chunks):
    return {lines[r.chunk_index * 100 + r.line_no - 1] for r in scanned.noise(chunks, model).collect() if r.kind == "misread"}


def test_the_context_of_a_place_decides(spark):
    """One word is real in one place and a misreading in another; without vectors all rows come out."""
    rnd, lines = _topics(8)
    real = ["cattle wheat farm barn sheep", "soil crop farm hay plough", "cattle wheat pretectien barn sheep"]
    wrong = ["office paper farm clerk stamp", "office paper forrn clerk stamp", "office paper pretecticn clerk stamp"]
    lines += real + wrong
    rnd.shuffle(lines)
    chunks = _chunks(spark, lines)
    model = scanned.learn(chunks)
    assert _misread(spark, lines, model, chunks) == set(wrong)
    text = " ".join(r.text for r in scanned.repaired(chunks, model).collect())
    assert text.count("office paper form clerk stamp") >= 2 and text.count("farm") == 2 and text.count("pretectien") == 1
    model.word_vectors.near[:] = 0
    assert _misread(spark, lines, model, chunks) == {*real, *wrong}


def test_pairs_of_characters_are_learned(spark, monkeypatch):
    """Rare ones without a list; a listed pair of frequent ones is told apart place by place; a real rare character stays."""
    monkeypatch.setattr(scanned, "LOOKALIKES", ("信行",))
    rnd = random.Random(4)
    words = ["申請手続", "報告公開", "行政機関", "行政機関", "信用評価", *["".join(chr(0x5100 + 4 * i + k) for k in range(4)) for i in range(18)]]
    lines = ["".join(rnd.choice(words) for _ in range(6)) for _ in range(6000)]
    truth = set()
    for i in range(0, 3000, 20):
        seen, written = (("甲", "申"), ("服", "報"), ("信", "行"))[i // 20 % 3]
        if written in lines[i]:
            k = lines[i].index(written)
            lines[i] = lines[i][:k] + seen + lines[i][k + 1 :]
            truth.add(lines[i])
    rare = [lines[i][:8] + "玻璃" + lines[i][8:] for i in range(3700, 3760, 3)]
    lines[3700:3760:3] = rare
    chunks = _chunks(spark, lines)
    model = scanned.learn(chunks)
    assert model.partners == {"甲": ("申",), "服": ("報",), "信": ("行",)}
    assert _misread(spark, lines, model, chunks) == truth
    fixed = "".join(r.text for r in scanned.repaired(chunks, model).collect())
    assert "甲" not in fixed and "服" not in fixed and "信政" not in fixed and fixed.count("玻璃") == len(rare)
    model.char_vectors.near[:] = 0
    assert len(_misread(spark, lines, model, chunks)) < len(truth)  # the counts alone don't tell


def test_links_agree_with_the_edits(spark):
    """The table of edits turned round gives what trying all edits gives."""
    m = scanned.Model()
    m.floor = 1
    m.words = {w: 100 + len(w) for w in ("form", "burn", "minimum", "clerk", "will", "hall", "vow", "little", "credit", "modern", "winning")}
    m.finish()
    rnd = random.Random(1)
    for w in sorted(m.strong):
        for _ in range(200):
            seen, written = rnd.choice(scanned.GLYPHS)
            x = w.replace(written, seen, 1)
            if x != w and x.isalpha() and len(x) > 1 and x not in m.words:
                assert set(m.links(x)) == m.strong.keys() & set(scanned.plausible(x)), x


@pytest.mark.parametrize(("block", "every"), [(20, 0), (24, 30), (24, 700)])
def test_blocks_make_no_difference(spark, block, every):
    """A long source cut into blocks gives the rows and paragraphs of the whole, however long these are."""
    text = _clean_lines("/root/testdata/sf0.01", "en")[:160_000]
    lines, _ = _noisy(text, 60, 3, "A Running Title of Things", (("c", "e"), ("rn", "m")))
    if every:
        lines = [x + "\n\n" if i % every == every - 1 else x for i, x in enumerate(lines)]
    rows = [("long", c // 40, "\n".join(lines[c : c + 40]), 1) for c in range(0, len(lines), 40)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    assert len(rows) > 2.5 * block
    model = scanned.learn(chunks)
    whole = {tuple(r) for r in scanned.noise(chunks, model).collect()}
    assert {tuple(r) for r in scanned.noise(chunks, model, block=block).collect()} == whole

    def joined(**kw):
        out = []
        for r in sorted(scanned.repaired(chunks, model, **kw).collect(), key=lambda r: (r.block, r.paragraph)):
            if r.continued:
                out[-1] += " " + r.text
            else:
                out.append(r.text)
        return out

    assert joined(block=block) == joined()


def test_clean_text_has_no_noise(spark):
    rows = [("s", i, "A plain sentence about registers.\nAnother line without any noise in it.\n2013\n", 0) for i in range(6)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    assert scanned.noise(chunks, scanned.learn(chunks)).count() == 0
    empty = chunks.limit(0)
    assert scanned.noise(empty, scanned.learn(empty)).count() == 0


@pytest.mark.parametrize(
    ("line", "shape"),
    [("- 75 -", 75), ("[94]", 94), ("２２", 22), ("43/234", 43), ("Page 57 of 310", 57), ("p. 12", 12), ("138 | P a g e", 138), ("Ⅲ－31", 31), ("第12页", 12), ("  12 ", 12), ("12 34", None), ("215   451", None), ("1. Title", None), ("", None), ("text", None), ("-", None)],
)
def test_page_numbers(line, shape):
    p = scanned.page_number(line)
    assert (p and p[1]) == shape


def test_title_on_first_chunk_is_kept():
    lines = [scanned.Line(0, 1, "Some Running Title")]
    for p in range(4):
        lines += [scanned.Line(p, 10 + i, f"body line {p} {i} and more words, ending here.") for i in range(20)]
        lines += [scanned.Line(p, 40, f"[{p + 7}]"), scanned.Line(p, 41, "SOME RUNNlNG TITLE" if p == 2 else "SOME RUNNING TITLE")]
    scanned.mark_furniture(lines, set())
    assert lines[0].kind is None
    assert [x.kind for x in lines if x.no == 40] == ["page_number"] * 4
    assert [x.kind for x in lines if x.no == 41] == ["header"] * 4
    assert not any(x.kind for x in lines if 10 <= x.no < 40)


def test_edits():
    assert {"trade", "records"} <= {*scanned.plausible("frade"), *scanned.plausible("rec0rds")}
    assert "first" in set(scanned.plausible("ﬁrst")) and "capacity" in set(scanned.plausible("capäcity"))
    assert scanned.outline("adrninistrative") == scanned.outline("administrative")
