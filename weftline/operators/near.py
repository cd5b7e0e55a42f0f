"""All near pairs of two blocks of strings: edit distances along a trie, whole branches given up at once.

The strings of one block are a trie of their ends; the other block's are the patterns, whose columns of distances are
kept as bit vectors (Myers) and advanced a character at a time for many (pattern, node) pairs together. A node is given
up where no string below it can be near: of a column, the entry on the diagonal that leads to the end is a lower bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CELLS = 1 << 22
FRONT = 1 << 21
U = np.uint64


def allowed(length: np.ndarray, threshold: float) -> np.ndarray:
    """The edits that leave a similarity of the threshold, by the length of the longer string."""
    return np.floor((1 - threshold) * length + 1e-9).astype(np.int32)


@dataclass
class Level:
    """Nodes of one depth, in order; ``first`` and ``children`` are those of the next depth."""

    code: np.ndarray
    middle: np.ndarray  # of the lengths below
    slack: np.ndarray
    most: np.ndarray
    end: np.ndarray  # the string that ends here, or -1
    first: np.ndarray
    children: np.ndarray


@dataclass
class Run:
    """Strings whose lengths need the same number of words, as many as fit a matrix."""

    index: np.ndarray
    length: np.ndarray
    codes: np.ndarray
    words: int


def runs(names: list[str], codes: dict[str, int]) -> list[Run]:
    """The strings with their characters from the end, sorted by these, in runs; ``codes`` gets new characters."""
    size = np.array([len(x) for x in names], np.int32)
    words = 1 << np.ceil(np.log2(np.maximum(1, -(-size // 64)))).astype(int)
    out = []
    for w in np.unique(words).tolist():
        own = sorted(np.flatnonzero(words == w).tolist(), key=lambda i: names[i][::-1])
        step = max(1, CELLS // (64 * w))
        for at in range(0, len(own), step):
            index = np.array(own[at : at + step])
            matrix = np.full((len(index), int(size[index].max())), -1, np.int32)
            for row, i in enumerate(index.tolist()):
                matrix[row, : size[i]] = [codes.setdefault(c, len(codes)) for c in reversed(names[i])]
            out.append(Run(index, size[index], matrix, w))
    return out


def trie(run: Run, threshold: float) -> list[Level]:
    n, depth = run.codes.shape
    shared = np.full(n, -1)
    shared[1:] = (run.codes[1:] != run.codes[:-1]).argmax(1)
    levels, starts = [], np.zeros(1, int)
    for k in range(depth + 1):
        # Characters are in the order of the strings, and -1, the end, is before all.
        cut = np.flatnonzero(shared < k) if k else starts
        low, high = np.minimum.reduceat(run.length, cut), np.maximum.reduceat(run.length, cut)
        at = cut[run.length[cut] >= k]
        low, high = low[run.length[cut] >= k], high[run.length[cut] >= k]
        middle = (low + high) >> 1
        levels.append(Level(run.codes[at, k - 1] if k else at, middle - k, high - middle, allowed(high, threshold), np.where(run.length[at] == k, at, -1).astype(np.int32), at[:0], at[:0]))
        if k:
            parent = np.searchsorted(starts, at, "right") - 1
            edge = np.searchsorted(parent, np.arange(len(starts) + 1))
            levels[-2].first, levels[-2].children = edge[:-1].astype(np.int32), np.diff(edge).astype(np.int32)
        starts = at
    levels[-1].first = levels[-1].children = np.zeros(len(starts), np.int32)
    return levels


def near(patterns: Run, levels: list[Level], codes: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(pattern, string, distance)`` of all pairs within the distance allowed, by their places in the runs."""
    widest = max(len(x.code) for x in levels)
    step = max(1, FRONT // (widest * patterns.words))
    for at in range(0, len(patterns.index), step):
        for p, s, d in _walk(patterns.codes[at : at + step], patterns.length[at : at + step], patterns.words, levels, codes, threshold):
            yield p + at, s, d


def _walk(rows: np.ndarray, length: np.ndarray, words: int, levels: list[Level], codes: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    n, m = len(rows), length
    r, i = np.nonzero(rows >= 0)
    equal = np.zeros((words, n * codes), U)  # the places of each character in each pattern
    np.bitwise_or.at(equal, (i >> 6, r * codes + rows[r, i]), U(1) << (i & 63).astype(U))
    upto = np.arange(words * 64 + 1)
    masks = [np.where(upto - 64 * w >= 64, ~U(0), (U(1) << np.clip(upto - 64 * w, 0, 63).astype(U)) - U(1)) for w in range(words)]
    own = allowed(m, threshold)
    q, node = np.arange(n), np.zeros(n, int)
    plus, minus = [np.full(n, ~U(0)) for _ in range(words)], [np.zeros(n, U) for _ in range(words)]

    def entry(plus: list[np.ndarray], minus: list[np.ndarray], k: int, row: np.ndarray) -> np.ndarray:
        """Entries of these rows of the columns."""
        out = np.full(len(row), k, np.int32)
        for w in range(words):
            out += np.bitwise_count(plus[w] & masks[w][row])
            out -= np.bitwise_count(minus[w] & masks[w][row])
        return out

    for k in range(1, len(levels)):
        above, here = levels[k - 1], levels[k]
        many = above.children[node]
        if many.size and many.min() == 1 == many.max():
            node = above.first[node]
        else:
            back = np.repeat(np.arange(len(node)), many)
            node = np.arange(len(back)) + (above.first[node] - (np.cumsum(many) - many))[back]
            q, plus, minus = q[back], [x[back] for x in plus], [x[back] for x in minus]
        if not len(node):
            return
        code = q * codes + here.code[node]
        up, down = None, None  # what the word before carries; the first row grows by one a column
        for w in range(words):
            v, x = plus[w], minus[w]
            e = equal[w][code]
            ev = e | x
            if down is not None:
                e |= down
            d = e & v
            d += v
            d ^= v
            d |= e
            h = d | v
            np.invert(h, out=h)
            h |= x
            g = v & d
            if w + 1 < words:
                up_next, down_next = h >> U(63), g >> U(63)
            h <<= U(1)
            h |= U(1) if up is None else up
            g <<= U(1)
            if down is not None:
                g |= down
            minus[w] = h & ev
            ev |= h
            np.invert(ev, out=ev)
            ev |= g
            plus[w] = ev
            if w + 1 < words:
                up, down = up_next, down_next
        mq = m[q]
        row = mq - here.middle[node]
        most = np.maximum(own[q], here.most[node])
        least = entry(plus, minus, k, np.maximum(row, 0)) - np.minimum(row, 0) - here.slack[node]
        keep = least <= most
        end = here.end[node]
        last = np.flatnonzero(keep & (end >= 0))
        if len(last):
            d = entry([x[last] for x in plus], [x[last] for x in minus], k, mq[last])
            good = d <= np.maximum(own[q[last]], allowed(np.array(k), threshold))
            last = last[good]
            if len(last):
                yield q[last], end[last], d[good]
        keep &= here.children[node] > 0
        if not keep.all():
            stay = np.flatnonzero(keep)
            q, node, plus, minus = q[stay], node[stay], [x[stay] for x in plus], [x[stay] for x in minus]
