"""Noise in text from scanned pages: running headers, page numbers, divided words and misread characters.

1. *Statistics* over all chunks: counts of words, of character trigrams inside words (Latin script) and of character
   trigrams of running text (Han and Kana), and of the lines next to page numbers.
2. *Skip-gram vectors*, trained with negative sampling on the counts of all pairs within a window, of every word and
   character above a share of all (so their number is bounded, whatever the text); each place of the window has
   context vectors of its own.
3. *Links*: a rare word may be a misreading of any frequent one, at least ``RATIO`` times more frequent, that one
   plausible glyph edit leads to (several in a long word). A character may be a misreading of a frequent one that it
   looks like, by the list below, or that the characters beside it call for at most of its places (learned from the
   vectors, by a pass over the trigrams).
4. *Lines*: page numbers are lines that form a rising sequence of one format; headers are lines without sentence end
   that recur at page edges, within the source or across sources, or are nearly such a line; a word at a line's end
   is divided if the parts joined make a word or no known compound. Then every occurrence of a word or character that
   has a link is judged in its own context: the vectors of the words around it say how much better each linked one
   fits than the one that is seen (a rare word fits as any), which together with the counts gives the odds.
5. *Repair*: misreadings replaced, divided words joined, furniture dropped, lines reflowed into paragraphs.

Beside the vectors only what has no context is decided by itself: joined-letter glyphs, digits in numbers, and names
that hold something that is no letter, by the trigrams inside words.

What is broadcast is bounded: words, trigrams and lines above a share of all occurrences; links are found where a word
is met. A source of more than ``BLOCK`` chunks is handled in blocks with ``HALO`` chunks of surroundings on either side,
so none is too large for a task: page numbers, titles, divided words and paragraphs go on over the seam.

Edge cases: null texts and sources take no part; repeated rows give one result; empty and blank lines have no kind;
text without any noise gives no rows; line numbers count ``\\n`` only; extra columns are ignored; an empty table gives
an empty result; very long lines are handled whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
HALO = 8
RATIO = 25
WORD_SHARE = 4e-6  # of all words: at most 250,000 words are broadcast
UNIT_SHARE = 1e-4  # of all characters: at most 10,000 have vectors, as have words (RATIO * WORD_SHARE)
EDGE_SHARE = 1e-5  # of all lines next to page numbers
PAIR_SHARE = 1e-7  # of all pairs within the window: at most ten million reach the driver
RARE_SHARE = 1e-6  # of all characters: rarer ones are not learned to be misreadings
WINDOW = 2
PLACES = 2 * WINDOW
DIM = 24
NEGATIVE = 5.0
PLACE_MOST = 6.0  # what one place of a context counts at most, for or against
WORD_DOUBT = 0.0  # how far the odds may be against a misread word
CHARACTER_GAIN = 1.0  # log odds that a misread character needs
LEARNED_FIT = 3.0  # log odds by the characters beside it, of a place that counts for a pair
LEARNED_MOST = 0.6  # share of the places of a rare character that must count for a pair
LEARNED_PLACES = 4  # different ones
HYPHENS = "-­¬‐‑"

#: Glyph confusions in print, seen -> written, in lower case.
GLYPHS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("|", "l"), ("|", "i"), ("!", "l"), ("(", "c"), ("[", "l"), ("$", "s"), ("@", "a"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("f", "e"), ("l", "i"), ("i", "l"), ("l", "t"), ("b", "h"), ("h", "b"), ("h", "li"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"), ("u", "n"), ("n", "u"), ("o", "c"), ("o", "e"), ("e", "o"), ("a", "o"), ("s", "a"), ("j", "i"), ("i", "j"), ("r", "n"), ("k", "lc"),
    ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("ni", "m"), ("nn", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("ll", "u"), ("li", "h"), ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("ti", "n"), ("lc", "k"), ("lo", "b"), ("ol", "d"), ("tt", "n"), ("rr", "n"), ("iii", "m"),
)
#: Pairs of like-shaped characters of running text; either may be read for the other.
LOOKALIKES = (
    "タ夕", "ト卜", "ロ口", "カ力", "エ工", "ニ二", "ハ八", "ー一", "チ千", "ミ三", "オ才", "ヌ又", "ム厶", "ヘへ", "リり", "ンソ", "シツ", "ノ丿", "ヲヨ", "ケク", "ラう", "セせ", "バパ", "ビピ", "ブプ", "ベペ", "ボポ",
    "申甲", "申由", "由田", "日曰", "日目", "白自", "大太", "大犬", "天夫", "木本", "未末", "土士", "己已", "已巳", "人入", "入八", "千干", "干于", "王玉", "力刀", "刀刃", "貝見", "問間", "間聞", "開閉", "待侍", "待持", "微徴", "徴徽", "網綱", "綱網", "緑録", "緑縁", "検険", "検倹", "検捡", "检捡", "险检", "積績", "責貴", "遺遣", "列刑", "例列", "宮官", "官宫", "住往", "往佳", "推堆", "維唯", "評坪", "评坪", "村材", "林材", "札礼", "札机", "受愛", "侯候", "復複", "複覆", "給絡", "設没", "設説", "説読", "記紀", "規現", "現規", "場揚", "体休", "作昨", "払私", "私払", "処拠", "罰罸", "輸輪", "転軽", "科料", "件仵", "先光", "告吉", "吉古", "古右", "右石", "名各", "合会", "会合", "公分", "分公", "不木", "年午", "午牛", "信倍", "値植", "直真", "員負", "具貝", "委季", "季李", "市巾", "市布", "法怯", "注住", "治冶", "決快", "清情", "情惰", "構購", "講構", "権催", "管菅", "営宮", "議義", "機械", "録禄", "履覆", "歴暦", "税悦", "訪坊", "访坊", "该核", "设没", "许计", "计汁", "记纪", "证征", "诉拆", "讨付", "让止", "订灯", "词同", "试式", "误吴", "请清", "调凋", "谈淡", "责贵", "财材", "货贷", "质盾", "购狗", "贡责", "资货", "赔陪",
)

LIGATURES = re.compile("[ﬀ-ﬆ]")
CJK = re.compile("[぀-ヿ㐀-鿿]")
LATIN_WORD = re.compile(r"[^\W\d_]", re.ASCII)
NUMBER = r"[0-9OoIl|SB]{1,4}"
ROMAN = r"[ivxlcIVXLCⅠ-ⅿ]{1,6}"
PAGE = re.compile(rf"^[\W_]*(?:(?P<part>{ROMAN}|[A-Z]|\d{{1,2}})\s*[-.:]\s*)?(?P<n>{NUMBER})(?P<of>\s*(?:/|of|von)\s*{NUMBER})?[\W_]*$", re.IGNORECASE)
#: Words that may stand with a page number; letters may be spaced out.
PAGE_WORD = re.compile(r"(?<![^\W_])(?:p\s*a\s*g\s*e\s*s?|pp?|s\s*e\s*i\s*t\s*e)(?![^\W\d_])|第(?=\s*\d)|(?<=\d)\s*(?:頁|页|ページ)", re.IGNORECASE)
DIGITS = str.maketrans({"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "S": "5", "B": "8"})
SENTENCE_END = tuple(".!?。！？;；,，、:：」』”")
DIGIT_BESIDE = re.compile(r"\d[oOlI]|[oOlI]\d")  # what MIXED needs at least
MIXED = re.compile(r"(?<![^\W_])(?=[0-9A-Za-z]*[0-9])(?=[0-9A-Za-z]*[oOlI])[0-9oOlI]{2,}(?![A-Za-z])|\d[oOlI](?=\d)")
EDGE = "\"'“”‘’«»,.;:!?)]}（）「」『』、。，；：？！…"


def core(token: str) -> str:
    """A word without the punctuation around it."""
    return token.strip(EDGE).lstrip("([{")


@lru_cache(maxsize=1)
def _edits() -> dict[str, tuple[str, ...]]:
    out = defaultdict(list)
    for seen, written in GLYPHS:
        out[seen].append(written)
    return {k: tuple(v) for k, v in out.items()}


def plausible(word: str) -> Iterator[str]:
    """Words that one glyph edit makes of ``word``; ligatures and accents are always resolved."""
    if not word.isascii():
        base = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word)) if not unicodedata.combining(c))
        if base != word:
            yield base
            word = base
    edits = _edits()
    for i in range(len(word)):
        for size in (1, 2, 3):
            seen = word[i : i + size]
            if len(seen) == size and seen in edits:
                for written in edits[seen]:
                    yield word[:i] + written + word[i + size :]
        if not word[i].isalpha() and word[i] not in "-'’" and not word.isdigit():
            for c in "abcdefghijklmnopqrstuvwxyz":
                yield word[:i] + c + word[i + 1 :]


_ALIKE = str.maketrans("0oe([1itf|!jb68q9uy5$", "ccccclllllllhhhggnvss")


def outline(word: str) -> str:
    """Equal for words that differ in plausible glyph edits only, however many; coarse."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word)) if not unicodedata.combining(c))
    for seen, same in (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "n"), ("ri", "n"), ("in", "m")):
        word = word.replace(seen, same)
    return word.translate(_ALIKE)


def title_key(line: str) -> str:
    """Letters only, case and width folded: equal for a running title whatever it holds besides."""
    return NO_LETTER.sub("", (line if line.isascii() else unicodedata.normalize("NFKC", line)).casefold())


def page_number(line: str) -> tuple[str, int] | None:
    """(format, number) of a line that may hold nothing but a page number."""
    t = line.strip()
    if not t or len(t) > 24:
        return None
    wide = unicodedata.normalize("NFKC", t)
    bare = PAGE_WORD.sub(" ", wide)
    m = PAGE.match(bare)
    if not m or not any(c.isdigit() for c in m["n"]):
        return None
    shape = re.sub(r"\d+", "#", re.sub(r"\s", "", t))
    if m["of"]:
        shape = "of"
    elif m["part"]:
        shape = "part"
    elif bare != wide:
        shape = "word"
    elif wide != t:
        shape = "wide"
    return shape, int(m["n"].translate(DIGITS))


# ---------------------------------------------------------------- statistics


NO_LETTER = re.compile(r"[\W\d_]+")
HEADING = re.compile(r"^\s*\d{1,2}[.．]\s*[^\W\d]")
INNER = re.compile("[,，、;；。]")


def _title_like(line: str) -> bool:
    t = line.strip()
    return 2 < len(t) <= 110 and not t.endswith(SENTENCE_END) and not INNER.search(t) and not HEADING.match(t)


def _words_of(lines: list[str]) -> list[str]:
    """Words of the lines in order, lower case, with divided words joined by guess left out ('' in their place)."""
    out = []
    cut = False
    for line in lines:
        tokens = line.split()
        if not tokens:
            continue
        if cut:
            tokens[0] = ""
        cut = tokens[-1][-1:] in HYPHENS and len(tokens[-1]) > 1
        if cut:
            tokens[-1] = ""
        out += tokens
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, grams, edges = Counter(), [], Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            lines = text.split("\n")
            for i, line in enumerate(lines):
                if len(line) < 50 and page_number(line):
                    for step in (-1, 1):
                        j = i + step
                        while 0 <= j < len(lines) and not lines[j].strip() and abs(j - i) < 3:
                            j += step
                        if 0 <= j < len(lines) and abs(j - i) <= 3 and _title_like(lines[j]) and len(title_key(lines[j])) > 3:
                            edges[lines[j].strip()] += 1
            if CJK.search(text):
                grams.append(np.frombuffer(text.replace("\n", "").encode("utf-32-le"), np.uint32).astype(np.int64))
            words.update(_words_of(lines))
    plain = Counter()
    for w, n in words.items():
        if w and LATIN_WORD.search(w) and not CJK.search(w):
            c = core(w).lower()
            if c:
                plain[c] += n
    inner = Counter()
    for w, n in plain.items():
        p = f"^{w}$"
        for i in range(len(p) - 2):
            inner[p[i : i + 3]] += n
    rows = [("w", w, n) for w, n in plain.items()] + [("i", g, n) for g, n in inner.items()] + [("e", k, n) for k, n in edges.items()]
    for key, n in _count_grams(grams):
        rows.append(("c", key, n))
    for i in range(0, len(rows), 20_000):
        part = list(zip(*rows[i : i + 20_000]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.int64())], ["kind", "key", "n"])


def _count_grams(texts: list[np.ndarray]) -> Iterator[tuple[str, int]]:
    """Counts of the trigrams whose middle is Han or Kana."""
    keys = []
    for x in texts:
        if len(x) > 2:
            mid = x[1:-1]
            ok = ((mid >= 0x3040) & (mid <= 0x30FF)) | ((mid >= 0x3400) & (mid <= 0x9FFF))
            keys.append(((x[:-2] << 42) | (mid << 21) | x[2:])[ok])
    if keys:
        values, counts = np.unique(np.concatenate(keys), return_counts=True)
        for v, n in zip(values.tolist(), counts.tolist()):
            yield chr(v >> 42) + chr((v >> 21) & 0x1FFFFF) + chr(v & 0x1FFFFF), n


# ---------------------------------------------------------------- vectors


def train(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, v: int, contexts: int, dim: int = DIM, rounds: int = 40, negative: float = NEGATIVE, seed: int = 5, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors with negative sampling from pair counts (unit, context, count): the expected gradient, by Adagrad.

    Gives the vectors of ``v`` units and of ``contexts`` contexts. Units are taken in blocks, so memory grows with the
    contexts only.
    """
    rng = np.random.default_rng(seed)
    w, c = (rng.standard_normal((v, dim)) * 0.1).astype(np.float32), (rng.standard_normal((contexts, dim)) * 0.1).astype(np.float32)
    p = counts.astype(np.float32) ** 0.75  # frequent pairs are damped, as by subsampling
    order = np.argsort(rows, kind="stable")
    rows, cols, p = rows[order], cols[order], p[order]
    noise = np.bincount(cols, p, contexts) ** 0.75
    noise = (noise / max(noise.sum(), 1e-9)).astype(np.float32)
    starts = np.searchsorted(rows, np.arange(0, v + block, block))
    gw, gc = np.full_like(w, 1e-6), np.full_like(c, 1e-6)
    for _ in range(rounds):
        dw, dc = np.zeros_like(w), np.zeros_like(c)
        for at, lo, hi in zip(range(0, v, block), starts, starts[1:]):
            seen = np.zeros((min(block, v - at), contexts), np.float32)
            seen[rows[lo:hi] - at, cols[lo:hi]] = p[lo:hi]
            weight = np.maximum(seen.sum(1, keepdims=True), 1e-6)
            seen /= weight * (1 + negative)
            near = w[at : at + block]
            s = 1 / (1 + np.exp(-np.clip(near @ c.T, -15, 15)))
            d = seen * (1 - s) - (negative / (1 + negative)) * noise * s
            dw[at : at + block] = d @ c
            dc += d.T @ near
        gw += dw**2
        gc += dc**2
        w += 0.3 * dw / np.sqrt(gw)
        c += 0.3 * dc / np.sqrt(gc)
    return w, c


class Vectors:
    """Skip-gram vectors of the frequent units, with a context vector for each place of the window."""

    def __init__(self, counts: dict[str, int], pairs: tuple[np.ndarray, ...]):
        """``pairs``: (distance, unit, the unit that follows at that distance, count)."""
        self.units = {u: i for i, u in enumerate(sorted(counts))}
        self.log = {u: log(n) for u, n in counts.items()}
        v = len(self.units)
        step, a, b, n = pairs
        # The places are 2 before, 1 before, 1 after and 2 after; a pair is seen from both of its ends.
        rows, cols = np.concatenate([a, b]), np.concatenate([(PLACES // 2 - 1 + step) * v + b, (PLACES // 2 - step) * v + a])
        near, around = train(rows, cols, np.concatenate([n, n]), v, PLACES * v) if v else np.zeros((2, 0, DIM), np.float32)
        self.near, self.around = near, np.concatenate([around.reshape(PLACES, v, DIM), np.zeros((PLACES, 1, DIM), np.float32)], axis=1)

    def fits(self, units: list[str], context: np.ndarray) -> np.ndarray:
        """Log of how much likelier each unit is than anywhere, by each row of unit numbers around and each place.

        A unit without vector is as likely as anywhere, and a place without unit says nothing.
        """
        around = self.around[np.arange(PLACES), context]  # rows, places, dim
        known = np.array([self.units.get(u, -1) for u in units])
        # Negative sampling leaves out the log of the number of negatives.
        return np.where((known[:, None, None] >= 0) & (context >= 0), np.einsum("ud,rpd->urp", self.near[known], around) + log(NEGATIVE), 0.0)

    def gain(self, written: str, seen: str, context: np.ndarray) -> np.ndarray:
        """How much more likely ``written`` is than ``seen`` by each row of contexts; one place decides little."""
        fit = self.fits([written, seen], context)
        return np.clip(fit[0] - fit[1], -PLACE_MOST, PLACE_MOST).sum(1)


def _pair_counter(words: dict[str, int], chars: dict[str, int], titles: dict[str, int]):
    """``(kind, a, b, n)``: counts of pairs of units; kind: distance for words, WINDOW + distance for characters.

    Also counts each line of ``titles``, as kind 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}

        def unit(token: str) -> int:
            k = cache.get(token)
            if k is None:
                k = words.get(core(token).lower(), -1)
                if len(cache) < 300_000:
                    cache[token] = k
            return k

        table = np.full(0x110000, -1, np.int32)
        for u, k in chars.items():
            table[ord(u)] = k
        lined: Counter = Counter()
        hold: tuple[list, list] = ([], [])

        def flush():
            for kind, arrays in enumerate(hold):
                if not arrays:
                    continue
                ids = np.concatenate(arrays)
                arrays.clear()
                for step in range(1, WINDOW + 1):
                    x, y = ids[:-step], ids[step:]
                    ok = (x >= 0) & (y >= 0)
                    key, n = np.unique((x[ok].astype(np.int64) << 32) | y[ok], return_counts=True)
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind * WINDOW + step, np.int32)), pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["kind", "a", "b", "n"])

        size = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                lines = text.split("\n")
                for line in lines:
                    if line in titles or (line[-1:].isspace() or line[:1].isspace()) and line.strip() in titles:
                        lined[titles[line.strip()]] += 1
                cjk = bool(CJK.search(text))
                ids = table[_points(text.replace("\n", ""))] if cjk else np.array([unit(t) if t else -1 for t in _words_of(lines)], np.int32)
                hold[cjk].append(np.append(ids, np.full(WINDOW, -1, np.int32)))
                size += len(ids)
                if size > 2_000_000:
                    yield from flush()
                    size = 0
        yield from flush()
        if lined:
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(lined), pa.int32()), pa.array(list(lined), pa.int32()), pa.array([0] * len(lined), pa.int32()), pa.array(list(lined.values()), pa.int64())], ["kind", "a", "b", "n"])

    return work


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


# ---------------------------------------------------------------- model


class Model:
    """What the lines are judged by; bounded in size."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.inner: dict[str, int] = {}
        self.titles: set[str] = set()
        self.captions: set[str] = set()  # lines that are next to page numbers only by chance
        self.partners: dict[str, tuple[str, ...]] = {}  # characters that may have been written for one that is seen
        self.chars: dict[str, int] = {}  # counts of these
        self.word_vectors = self.char_vectors = Vectors({}, (np.zeros(0, np.int64),) * 4)
        self.first_parts: set[str] = set()
        self.parts: set[str] = set()  # of compounds
        self.floor = 1  # rarer words are not in ``words``

    def finish(self) -> Model:
        for w in self.words:
            if "-" in w.strip("-"):
                self.first_parts.add(w.split("-")[0])
                self.parts.update(w.split("-"))
        self.strong = strong_words(self.words, self.floor)
        # All misreadings by one edit between letters, turned round: a look-up instead of a search.
        near = defaultdict(set)
        for w in self.strong:
            for seen, written in GLYPHS:
                at = w.find(written) if seen.isalpha() else -1
                while at >= 0:
                    near[w[:at] + seen + w[at + len(written) :]].add(w)
                    at = w.find(written, at + 1)
        self.near = {k: frozenset(v) for k, v in near.items()}
        outlines = defaultdict(set)
        for w in self.strong:
            outlines[outline(w)].add(w)
        self.outlines = {k: frozenset(v) for k, v in outlines.items()}
        seen = "".join(re.escape(c) for c in self.partners)
        self.suspects = re.compile(f"[{seen}]") if seen else None
        self.cache: dict[str, str | tuple[str, ...] | None] = {}
        return self

    def _count(self, word: str) -> int:
        return self.words.get(word, 0)

    def known(self, word: str) -> bool:
        return word in self.words and not self.links(word)

    def links(self, word: str) -> tuple[str, ...]:
        """The frequent words that a rare one may be a misreading of: one plausible edit away, or more from a long word."""
        n = self.words.get(word, 0)
        if len(word) < 2 or word.isdigit() or word in self.strong and n * RATIO > max(self.strong.values()):
            return ()
        found = self.near.get(word, frozenset()) if word.isascii() and word.isalpha() else self.strong.keys() & set(plausible(word))
        if len(word) == 2 and word.isalpha() and n:
            return ()
        if not found and not n and len(word) > 6 and self._least(word) < self.floor:  # else it reads like a name
            found = self.outlines.get(outline(word), frozenset())
        return tuple(sorted((f for f in found if f != word and self.strong[f] >= RATIO * max(n, self.floor)), key=lambda f: (-self.strong[f], f)))

    def choices(self, token: str) -> str | tuple[str, ...] | None:
        """What ``token`` may be a misreading of: one reading for certain, frequent words for the context, or None."""
        hit = self.cache.get(token, "?")
        if hit != "?":
            return hit
        out = self._choices(token)
        if len(self.cache) < 300_000:
            self.cache[token] = out
        return out

    def _choices(self, token: str) -> str | tuple[str, ...] | None:
        word = core(token).lower()
        if not token.isascii() and LIGATURES.search(token):
            return unicodedata.normalize("NFKC", token)
        if not word or not LATIN_WORD.search(word):
            return None
        bracket = token.strip(EDGE).lower()  # a bracket may be a misread letter
        if bracket != word and bracket[:1] in "([" and (found := self.links(bracket)) and RATIO * self._count(word) < self._count(found[0]):
            return found
        if found := self.links(word):
            return found
        if word in self.words:
            return None
        if "-" in word:
            parts = word.split("-")
            fixed = [self.likely(p) if p else None for p in parts]
            return "-".join(f or p for f, p in zip(fixed, parts)) if any(fixed) else None
        if word.isdigit() or MIXED.search(word) or word in self.parts:
            return None
        return None if word.isascii() and word.isalpha() else self._like_a_word(word)

    def likely(self, token: str) -> str | None:
        """The likeliest reading where there is no context: the most frequent one."""
        found = self.choices(token)
        return found[0] if isinstance(found, tuple) else found

    def correct(self, token: str, context: np.ndarray) -> str | None:
        """The word that was written, if ``token`` is a misreading by its context (one row); None if it is fine."""
        found = self.choices(token)
        if not isinstance(found, tuple):
            return found
        n = max(self.words.get(core(token).lower(), 0), self.floor)
        score, word = max((float(self.word_vectors.gain(f, "", context)[0]) + log(self.strong[f] / (RATIO * n)), f) for f in found)
        return word if score > -WORD_DOUBT else None

    def context(self, tokens: list[str], at: int, end: int) -> np.ndarray:
        """Numbers of the units before place ``at`` and from place ``end`` on."""
        units = self.word_vectors.units
        beside = [*range(at - PLACES // 2, at), *range(end, end + PLACES // 2)]
        return np.array([[units.get(core(tokens[k]).lower(), -1) if 0 <= k < len(tokens) else -1 for k in beside]])

    def _least(self, word: str) -> int:
        p = f"^{word}$"
        return min((self.inner.get(p[i : i + 3], 0) for i in range(len(p) - 2)), default=0)

    def _like_a_word(self, word: str) -> str | None:
        """For names that hold something that is no letter: an edit that makes common letter sequences of them."""
        low = self._least(word)
        if len(word) < 4:
            return None
        best = max(plausible(word), key=self._least, default=None)
        if best is not None and self._least(best) > max(20 * low, 8):
            return best
        return None

    def odd_characters(self, text: str) -> list[tuple[int, str]]:
        """(place, written character) of misread characters of running text, by the contexts of each."""
        places = [m.start() for m in self.suspects.finditer(text)] if self.suspects is not None else []
        if not places:
            return []
        table, vectors = self._table(), self.char_vectors
        ids = np.concatenate([np.full(WINDOW, -1, np.int32), table[_points(text)], np.full(WINDOW, -1, np.int32)])
        beside = [k for k in range(-WINDOW, WINDOW + 1) if k]
        by_char = defaultdict(list)
        for i in places:
            by_char[text[i]].append(i)
        out = []
        for c, at in by_char.items():
            context = ids[np.array(at)[:, None] + WINDOW + beside]
            options = self.partners[c]
            scores = np.stack([vectors.gain(w, c, context) + log(self.chars[w] / self.chars[c]) for w in options])
            best = scores.argmax(0)
            out += [(i, options[k]) for i, k, s in zip(at, best, scores.max(0)) if s > CHARACTER_GAIN]
        return sorted(out)

    def _table(self) -> np.ndarray:
        if not hasattr(self, "_numbers"):
            self._numbers = np.full(0x110000, -1, np.int32)
            for u, k in self.char_vectors.units.items():
                self._numbers[ord(u)] = k
        return self._numbers


def strong_words(words: dict[str, int], floor: int) -> dict[str, int]:
    """Words frequent enough for the rarest to be a misreading of them."""
    return {w: n for w, n in words.items() if n >= RATIO * floor}


def learn(chunks: DataFrame) -> Model:
    """Statistics, vectors and pairs of characters from all chunks."""
    texts = chunks.where(F.col("text").isNotNull()).select("text")
    stats = texts.mapInArrow(_statistics, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).persist()
    try:
        return _learn(texts, stats)
    finally:
        stats.unpersist()


def _learn(texts: DataFrame, stats: DataFrame) -> Model:
    m = Model()
    totals = {r["kind"]: r["t"] for r in stats.groupBy("kind").agg(F.sum("n").alias("t")).collect()}
    total_words, total_chars = totals.get("w", 0), totals.get("c", 0)
    floor = m.floor = max(2, int(total_words * WORD_SHARE))
    m.words = {r.key: r.n for r in stats.where("kind = 'w'").where(F.col("n") >= floor).select("key", "n").collect()}
    m.inner = {r.key: r.n for r in stats.where("kind = 'i'").where(F.col("n") >= max(2, int(total_words * 1e-6))).select("key", "n").collect()}
    # A title is next to page numbers again and again, in one source or in several.
    # At most 1 / EDGE_SHARE lines.
    beside = {r.key: r.n for r in stats.where("kind = 'e'").where(F.col("n") >= max(3, int(totals.get("e", 0) * EDGE_SHARE))).select("key", "n").collect()}
    names = sorted(beside)
    lines = {k: i for i, k in enumerate(names)}
    home = {r.c: r.n for r in stats.where("kind = 'c'").groupBy(F.substring("key", 2, 1).alias("c")).agg(F.sum("n").alias("n")).collect()}  # one row a character

    strong = strong_words(m.words, floor)
    frequent = {c: n for c, n in home.items() if n >= max(RATIO, total_chars * UNIT_SHARE)}
    number = [{u: i for i, u in enumerate(sorted(x))} for x in (strong, frequent)]
    counted = texts.mapInArrow(_pair_counter(*number, lines), "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # At most 1 / PAIR_SHARE pairs; rarer ones say nothing.
    counted = counted.where((F.col("kind") == 0) | (F.col("n") >= max(1, int(PAIR_SHARE * WINDOW * (total_words + total_chars))))).toArrow()
    kind, a, b, n = (counted[c].to_numpy() for c in ("kind", "a", "b", "n"))
    often, near = Counter(), Counter()
    for k in names:
        near[title_key(k)] += beside[k]
    for i, k in zip(a[kind == 0], n[kind == 0]):
        often[title_key(names[i])] += int(k)
    m.titles = {k for k, x in near.items() if x >= 0.4 * often[k]}
    m.captions = set(near) - m.titles
    for of_chars, units in enumerate((strong, frequent)):
        one = (kind > of_chars * WINDOW) & (kind <= (of_chars + 1) * WINDOW)
        vectors = Vectors(units, (kind[one] - of_chars * WINDOW, a[one], b[one], n[one]))
        if of_chars:
            m.char_vectors = vectors
        else:
            m.word_vectors = vectors
    m.partners = character_pairs(stats, home, total_chars, m.char_vectors)
    m.chars = {c: home[c] for c in {*m.partners, *[w for ws in m.partners.values() for w in ws]}}
    return m.finish()


def character_pairs(stats: DataFrame, home: dict[str, int], total: int, vectors: Vectors) -> dict[str, tuple[str, ...]]:
    """Characters that a seen one may stand for: frequent ones with a vector, rarer themselves or not.

    Learned: a rare character at most places of which, several different ones, the characters beside it call for the same frequent one. Listed
    look-alikes are plausible without this; it is always the context of a place that decides about it.
    """
    partners = defaultdict(set)
    for a, b in [*LOOKALIKES, *[pair[::-1] for pair in LOOKALIKES]]:
        if a in home and b in vectors.units and home[b] > home[a]:
            partners[a].add(b)
    rare = {c: n for c, n in home.items() if c not in vectors.units and CJK.match(c) and n >= max(4, total * RARE_SHARE)}
    if rare and vectors.units:
        shared = stats.sparkSession.sparkContext.broadcast((vectors, frozenset(rare)))

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vec, rare = shared.value
            names = np.array(list(vec.units))
            usual = np.array([vec.log[u] for u in names])
            script = np.array([bool(CJK.match(u)) for u in names])
            for batch in batches:
                rows = [(k, n) for k, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()) if k[1] in rare]
                for i in range(0, len(rows), 2048):
                    part = rows[i : i + 2048]
                    context = np.array([[-1] * (WINDOW - 1) + [vec.units.get(k[0], -1), vec.units.get(k[2], -1)] + [-1] * (WINDOW - 1) for k, _ in part])
                    fit = vec.fits(list(names), context).sum(2)
                    best = np.where(script[:, None], fit + usual[:, None], -np.inf).argmax(0)
                    found = [(k[1], names[w], n) for (k, n), w, x in zip(part, best, fit[best, np.arange(len(part))]) if x >= LEARNED_FIT]
                    cols = list(zip(*found)) if found else [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["c", "w", "n"])

        found = stats.where("kind = 'c'").select("key", "n").mapInArrow(votes, "c string, w string, n long").groupBy("c", "w").agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
        for r in found.where(F.col("contexts") >= LEARNED_PLACES).collect():  # at most one row for each two characters
            if r.n >= LEARNED_MOST * home[r.c] and home[r.w] >= RATIO * home[r.c]:
                partners[r.c].add(r.w)
    return {c: tuple(sorted(ws)) for c, ws in partners.items()}


# ---------------------------------------------------------------- lines


class Line:
    __slots__ = ("chunk", "no", "text", "kind", "hyphen", "fixed")

    def __init__(self, chunk, no, text):
        self.chunk, self.no, self.text, self.kind, self.hyphen, self.fixed = chunk, no, text, None, None, None


def _rising(found: list[tuple[int, int]]) -> set[int]:
    """Places whose numbers follow one another: of (place, number) in order, those near a neighbour of n + 1 to n + 2."""
    best: list[tuple[int, int]] = []  # length and previous of the best chain ending here
    for i, (_, n) in enumerate(found):
        top, before = 1, -1
        for j in range(max(0, i - 12), i):
            if 1 <= n - found[j][1] <= 3 and best[j][0] + 1 > top:
                top, before = best[j][0] + 1, j
        best.append((top, before))
    keep: set[int] = set()
    for i in sorted(range(len(found)), key=lambda i: -best[i][0]):
        if best[i][0] < 3:
            break
        j = i
        while j >= 0 and found[j][0] not in keep:
            keep.add(found[j][0])
            j = best[j][1]
    return keep


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits lead from a to b."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def mark_furniture(lines: list[Line], titles: set[str], captions: set[str] = frozenset()) -> None:
    """Sets ``kind`` of header and page_number lines of one source, lines in order."""
    full = [x for x in lines if x.text.strip()]
    numbers = defaultdict(list)
    for i, x in enumerate(full):
        if p := page_number(x.text):
            numbers[p[0]].append((i, p[1]))
    for shape, found in numbers.items():
        if shape == "#":  # bare years are text unless they count pages one by one
            years = [x for x in found if 1900 <= x[1] < 2100]
            chain = sorted(_rising(years))
            runs = [n for i, n in years if i in set(chain)]
            if len(runs) < 8 or any(q - p != 1 for p, q in zip(runs, runs[1:])):
                found = [x for x in found if not 1900 <= x[1] < 2100]
        keep = _rising(found)
        if not keep and shape != "#" and len(found) >= 2:
            keep = {i for i, _ in found}
        if not keep and shape != "#" and len(found) == 1 and len(numbers) == 1:
            keep = {found[0][0]}
        for i in keep:
            full[i].kind = "page_number"
    keys: dict[int, str] = {}
    count: Counter = Counter()
    for i, x in enumerate(full):
        if x.kind is None and _title_like(x.text) and len(k := title_key(x.text)) > 3 and k not in captions:
            keys[i] = k
            count[k] += 1
    edge: Counter = Counter()
    for i, k in keys.items():
        if count[k] > 1 or k in titles:
            beside = (i and full[i - 1].kind == "page_number") or (i + 1 < len(full) and full[i + 1].kind == "page_number")
            edge[k] += bool(beside or "\f" in full[i].text or _holds_number(full[i].text))
    headers = {k for k, n in count.items() if edge[k] >= 2 and edge[k] >= 0.4 * n} | {k for k in count if k in titles and edge[k] >= 1 and edge[k] >= 0.3 * count[k]}
    first = next((i for i, x in enumerate(full) if x.chunk == 0), None)
    for i, k in keys.items():
        if i == first and "\f" not in full[i].text and not _holds_number(full[i].text):
            continue
        if k in headers or any(_near(k, h, 1 + len(h) // 12) for h in headers if abs(len(h) - len(k)) <= 2 and (h[:2] == k[:2] or h[-2:] == k[-2:])):
            full[i].kind = "header"


def _holds_number(text: str) -> bool:
    t = unicodedata.normalize("NFKC", text).strip()
    return bool(re.search(r"^\W*\d{1,4}\s*(\||\s{3})|(\||\s{3})\s*\d{1,4}$", t))


def mark_words(lines: list[Line], model: Model) -> set[tuple[int, int]]:
    """Sets ``hyphen`` (the joined word) and ``fixed`` (tokens to replace) of body lines; lines with misreadings."""
    body = [x for x in lines if x.kind is None and x.text.strip()]
    odd: set[tuple[int, int]] = set()
    tokens = [x.text.split() for x in body]
    joined: dict[int, str] = {}
    for i in range(len(body) - 1):
        last, nxt = tokens[i][-1], tokens[i + 1][0]
        if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha() and last[-2].isascii() | (last[-2] in "äﬁﬂﬃ") and nxt[0].islower() | (nxt[0] in "(0156|"):
            a, b = core(last[:-1]), core(nxt)
            if not a:
                continue
            whole, pair = (a + b).lower(), f"{a}-{b}".lower()
            if model.known(whole) or not (pair in model.words or _compound(model, a.lower(), b.lower(), whole)):
                body[i].hyphen = joined[i] = last[:-1] + nxt
    cache, unseen = model.cache, "?"
    flat = [t for words in tokens for t in words]
    start = 0
    for i, x in enumerate(body):
        fixed = {}
        if not x.text.isascii() and LIGATURES.search(x.text) or DIGIT_BESIDE.search(x.text) and MIXED.search(x.text):
            odd.add((x.chunk, x.no))
        words = tokens[i]
        for j, t in enumerate(words):
            if (i in joined and j == len(words) - 1) or (i - 1 in joined and j == 0):
                continue
            c = cache.get(t, unseen)
            if c is unseen:
                c = model.choices(t)
            if c is not None and (c := model.correct(t, model.context(flat, start + j, start + j + 1))) is not None:
                fixed[j] = c
                odd.add((x.chunk, x.no))
        x.fixed = fixed
        start += len(words)
        if i in joined:
            whole = joined[i]
            c = model.correct(whole, model.context(flat, start - 1, start + 1))
            if c is not None:
                # The misread character lies in the part before or after the cut, where seen and written first differ.
                seen, head = core(whole).lower(), len(core(words[-1][:-1]))
                same = next((k for k, (p, q) in enumerate(zip(seen, c)) if p != q), min(len(seen), len(c)))
                at = x if same < head else body[i + 1]
                odd.add((at.chunk, at.no))
                x.hyphen = c
    if model.suspects is not None:
        parts, offsets, at = [], [], 0
        for x in body:
            offsets.append(at)
            parts.append(x.text)
            at += len(x.text)
        text = "".join(parts)
        if CJK.search(text):
            starts = np.array(offsets)
            swaps = defaultdict(dict)
            for i, w in model.odd_characters(text):
                k = int(np.searchsorted(starts, i, "right")) - 1
                odd.add((body[k].chunk, body[k].no))
                swaps[k][i - offsets[k]] = w
            for k, s in swaps.items():
                body[k].text = "".join(s.get(i, c) for i, c in enumerate(body[k].text))
    return odd


def _compound(model: Model, a: str, b: str, whole: str) -> bool:
    """Whether ``a-b`` looks like a compound broken at its own hyphen."""
    if a not in model.first_parts:
        return False
    fixed = model.likely(b) if b else None
    if f"{a}-{fixed or b}" in model.words:
        return True
    if (w := model.likely(whole)) is not None and w in model.words:
        return False
    return any(h.startswith(f"{a}-{b[:3]}") for h in model.words if h.startswith(a + "-"))


TABLE_ROW = re.compile(r"^\s*[\d.,%|-]+(?:\s{2,}|\s*\|\s*)[\d.,%|\s-]*$")


def paragraphs(lines: list[Line]) -> list[tuple[list[tuple[int, str]], int | None]]:
    """Continuous text of the lines, furniture dropped: (parts by chunk, chunk at which it ended, if it did).

    A blank line ends a paragraph; next to furniture, or between chunks, only if the sentence has ended, for there the
    page may have cut it. Headings, table rows, captions, bare numbers and the title at the start stand alone. In
    sources with one line per sentence group a short line that ends a sentence ends the paragraph.
    """
    widths = [len(x.text) for x in lines if x.kind is None and x.text.strip()]
    wide = float(np.percentile(widths, 90)) if widths else 0.0
    out: list[tuple[list[tuple[int, str]], int | None]] = []
    cur, parts, soft, hard, skip_first, chunk, after_row = "", [], False, False, False, None, False

    def close(end: int | None = None) -> None:
        nonlocal cur, parts
        if cur:
            out.append((parts, end))
        cur, parts = "", []

    first = next((x for x in lines if x.text.strip()), None)
    for i, x in enumerate(lines):
        if chunk is not None and x.chunk != chunk:
            soft = True
        chunk = x.chunk
        if x.kind is not None:
            soft = True
            continue
        if not x.text.strip():
            after_row = False
            beside = soft or (i + 1 < len(lines) and lines[i + 1].kind is not None)
            hard = hard or not beside
            soft = True
            continue
        ended = cur.endswith((".", "!", "?", "。", "！", "？"))
        alone = bool(HEADING.match(x.text) or TABLE_ROW.match(x.text) or x.text.strip().isdigit() or (after_row and len(x.text) < 0.8 * wide) or (x is first and x.chunk == 0 and _title_like(x.text)))
        if hard or alone or (soft and ended):
            close(x.chunk)
        hard = soft = False
        after_row = bool(TABLE_ROW.match(x.text))
        words = x.text.split()
        for j, c in (x.fixed or {}).items():
            words[j] = _like(words[j], c)
        if skip_first:
            words = words[1:]
        skip_first = x.hyphen is not None and bool(words)
        if skip_first:
            words[-1] = x.hyphen if x.hyphen != x.hyphen.lower() else _like(words[-1], x.hyphen)
        piece = ("   " if after_row else " ").join(words)
        if piece:
            han = bool(CJK.search(cur[-60:]) or CJK.search(piece[:60]))
            tight = not cur or (han and not (cur[-1:].isascii() and cur[-1:].isalpha() and piece[:1].isascii() and piece[:1].isalpha()))
            parts.append((x.chunk, piece if tight else " " + piece))
            cur += parts[-1][1]
        if alone or (len(x.text) < 0.6 * wide and cur.endswith((".", "。", "!", "?", "！", "？"))):
            close(x.chunk)
    close()
    return out


def _like(seen: str, written: str) -> str:
    """``written`` with the punctuation and capital of ``seen``."""
    c = core(seen)
    i = seen.find(c) if c else 0
    lead, tail = seen[:i].rstrip("(["), seen[i + len(c) :]
    if c[:1].isupper():
        written = written[:1].upper() + written[1:]
    return (lead if lead.strip("([") or not seen[:1] in "([" else "") + written + tail


def _blocks(chunks: DataFrame, block: int) -> DataFrame:
    """Chunks by source and block; the chunks near a block come with it."""
    i = F.col("chunk_index")
    at = F.array_distinct(F.array(*[F.floor((i + d) / block) for d in (-HALO, 0, HALO)]))
    rows = chunks.where(F.col("text").isNotNull() & F.col("source_id").isNotNull() & i.isNotNull()).select("source_id", i.cast("int").alias("chunk_index"), "text")
    return rows.withColumn("block", F.explode(at)).where((F.col("block") >= 0) | (i < 0))


def _lines_of(group: pa.Table, model: Model) -> tuple[list[Line], set[tuple[int, int]]]:
    """The lines of a block in order, marked; and where misread characters are."""
    seen, lines = set(), []
    index, texts = group["chunk_index"].to_pylist(), group["text"].to_pylist()
    for k in sorted(range(len(index)), key=lambda k: (index[k], texts[k])):
        if (index[k], texts[k]) in seen:
            continue
        seen.add((index[k], texts[k]))
        lines += [Line(index[k], n, t) for n, t in enumerate(texts[k].split("\n"), 1)]
    mark_furniture(lines, model.titles, model.captions)
    return lines, mark_words(lines, model)


def noise(chunks: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """``(source_id, chunk_index, line_no, kind)`` of every noisy line."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def work(key, group):
        mine = key[1].as_py()
        lines, odd = _lines_of(group, shared.value)
        rows = {(x.chunk, x.no, x.kind) for x in lines if x.kind}
        rows |= {(x.chunk, x.no, "hyphen") for x in lines if x.hyphen is not None} | {(c, n, "misread") for c, n in odd}
        rows = sorted(r for r in rows if r[0] // block == mine)
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.string()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["source_id", "chunk_index", "line_no", "kind"])

    return _blocks(chunks, block).groupBy("source_id", "block").applyInArrow(work, "source_id string, chunk_index int, line_no int, kind string")


def repaired(chunks: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """``(source_id, block, paragraph, continued, text)``: the same content as continuous paragraphs.

    A paragraph is in the block of its start. One that goes on for more than ``HALO`` chunks in the next block is given
    block by block, ``continued`` from the last one of the block before.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def work(key, group):
        mine = key[1].as_py()
        lines, _ = _lines_of(group, shared.value)
        text, continued = [], []
        for parts, end in paragraphs(lines):
            first = parts[0][0] // block
            # The block of the start saw this end; else each block has what lies in it.
            whole = end is not None and end < (first + 1) * block + HALO
            if whole and first != mine:
                continue
            own = "".join(t for c, t in parts if whole or c // block == mine)
            if own:
                text.append(own.strip())
                continued.append(first < mine)
        n = len(text)
        return pa.table(
            [pa.array([key[0].as_py()] * n, pa.string()), pa.array([mine] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(continued, pa.bool_()), pa.array(text, pa.string())],
            ["source_id", "block", "paragraph", "continued", "text"],
        )

    return _blocks(chunks, block).groupBy("source_id", "block").applyInArrow(work, "source_id string, block long, paragraph int, continued boolean, text string")
