"""Splitting oversized texts at natural boundaries, by byte ranges.

A text is never looked at as a whole:

1. *ranges*: it is cut into byte ranges, each with a halo of following bytes (and a few before) so that both
   neighbours find the same safe seam;
2. *boundaries*: a worker tokenizes one range and writes a table of its cut points, three bytes each: bytes and
   tokens since the last cut point, and the kind of boundary (paragraph, line, sentence, clause, word, none);
3. *stitching*: the tables of a text, in order, are prefix-summed and pieces are planned from them alone, with
   memory for about one piece. A text of more than ``PART_RANGES`` ranges is stitched in parts side by side: a part
   begins at the strongest boundary of its first range, with the overlap before it, and the one before ends there;
4. *pieces* are taken out of the text (or file) by offset.

Cut points lie between pre-tokens, where the byte-level tokenizers never join bytes, so the tokens of a piece are
the sum of its parts (or less by one where a piece ends in white space). A run of more than ``LONGEST`` bytes
without any such point gets points between characters; a piece next to such a cut keeps ``SLACK`` tokens free.

Texts of no more bytes than the limit are never tokenized: a token has at least one byte.

Edge cases: null and empty texts and texts within the limit give no pieces; a text without any boundary is cut
between characters; equal texts under several ids are all split; broken UTF-8 in files is read as replacement
characters for counting, offsets stay true; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.tokens import DEFAULT_TOKENIZER, load

RANGE_BYTES = 1 << 15
HALO = 1024
BEFORE = 16
PART_RANGES = 2048
LONGEST = 24  # bytes between cut points, at most 255
SLACK = 16
#: A piece is cut at the strongest boundary in the last part of its room.
FILL = 0.5
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE = 5, 4, 3, 2, 1, 0

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 4  # UNKNOWN: not assigned, Unicode versions may differ
SENTENCE_END = ".!?。！？…．｡"
CLAUSE_END = ",;:、，；：､"
CLOSERS = "\"')]}」』）】〉》”’〕］｝"


def _kind(c: str) -> int:
    cat = unicodedata.category(c)
    return UNKNOWN if cat == "Cn" else {"L": LETTER, "N": NUMBER}.get(cat[0], OTHER)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every character of the basic plane, and its role: 3 ends a sentence, 2 a clause, 1 closes."""
    kind = np.full(0x10000, OTHER, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        kind[i] = SPACE if c.isspace() and not 0x1C <= i <= 0x1F else _kind(c)
    role = np.zeros(0x10000, np.uint8)
    for chars, r in ((SENTENCE_END, 3), (CLAUSE_END, 2), (CLOSERS, 1)):
        role[[ord(c) for c in chars]] = r
    return kind, role


def _kinds(points: np.ndarray) -> np.ndarray:
    kind, _ = _tables()
    out = kind[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = _kind(chr(points[i]))
    return out


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _widths(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def safe_cuts(points: np.ndarray) -> np.ndarray:
    """Whether the place before each character is certainly between two pre-tokens; the first is not judged."""
    k = _kinds(points)
    out = np.zeros(len(points), bool)
    a, b = k[:-1], k[1:]
    left = points[:-1]
    out[1:] = np.where(a == SPACE, (b != SPACE) & (left != 32), (b == SPACE) | ((a != b) & (a != UNKNOWN) & (b != UNKNOWN) & (left != 39)))
    return out


def boundary_kinds(points: np.ndarray) -> np.ndarray:
    """The kind of natural boundary before each character."""
    _, role = _tables()
    k = _kinds(points)
    n = len(points)
    space = k == SPACE
    index = np.arange(n)
    newlines = np.concatenate([[0], np.cumsum((points == 10) | (points == 0x2028) | (points == 0x2029))])
    # The last visible character before each place, skipping white space, then skipping closing marks.
    last = np.maximum.accumulate(np.where(space, -1, index))
    prev = np.concatenate([[-1], last[:-1]])
    ahead = np.full(n + 1, n)
    ahead[:n] = np.minimum.accumulate(np.where(space, n, index)[::-1])[::-1]
    breaks = newlines[index] - newlines[np.maximum(prev + 1, 0)]
    following = newlines[ahead[:n]] - newlines[index]
    lines = np.where(space, following, 0)
    lines = np.maximum(lines, np.where(~space, breaks, 0))
    r = role[np.minimum(points, 0xFFFF)]
    effective = r.copy()
    for _ in range(2):  # a closing mark passes on the end before it
        shifted = np.concatenate([[0], effective[:-1]])
        effective = np.where(r == 1, np.where(shifted >= 2, shifted, 1), effective)
    end = np.where(prev >= 0, effective[np.maximum(prev, 0)], 0)
    ascii_end = np.where(prev >= 0, points[np.maximum(prev, 0)] < 128, False)
    touching = prev == index - 1
    end = np.where(touching & ascii_end & ~space & (end >= 2), 0, end)  # "3.5", "a.b": no boundary
    out = np.full(n, WORD, np.uint8)
    out[end == 2] = CLAUSE
    out[end == 3] = SENTENCE
    out[lines == 1] = LINE
    out[lines >= 2] = PARAGRAPH
    return out


def _seam(data: bytes, at: int) -> int:
    """The first safe cut at or after byte ``at`` within the halo, after no white space if there is one, else the first character start."""
    lo = at
    while lo < len(data) and lo < at + 4 and data[lo] & 0xC0 == 0x80:
        lo += 1
    begin = lo - 1
    while begin > 0 and data[begin] & 0xC0 == 0x80:
        begin -= 1
    if begin < 0:
        return lo
    window = data[begin : at + HALO]
    points = _codepoints(window.decode("utf-8", "ignore"))
    if len(points) < 2:
        return lo
    safe = safe_cuts(points)
    # White space at the end of a text may be one token less than in its midst, so the seam isn't after any if possible.
    inked = safe & (np.concatenate([[SPACE], _kinds(points)[:-1]]) != SPACE)
    safe = np.flatnonzero(inked if inked.any() else safe)
    return begin + int(_widths(points)[: safe[0]].sum()) if len(safe) else lo


def cut_table(text: str, tok, before: str = "", after: str = "") -> np.ndarray:
    """``(3, n)`` bytes: byte step, token step and kind of each cut point of ``text``; the last one is its end.

    ``before`` and ``after`` are what surrounds it, to judge its ends.
    """
    if not text:
        return np.zeros((3, 0), np.uint8)
    points = _codepoints(text)
    place = np.concatenate([[0], np.cumsum(_widths(points))])
    token_end = np.concatenate([[0], np.cumsum(tok.lengths(text))])
    around = _codepoints(before + text + after)
    skip, n = len(_codepoints(before)), len(points)
    safe, kinds = safe_cuts(around), boundary_kinds(around)
    at = np.flatnonzero(safe[skip + 1 : skip + n]) + 1
    last = PARAGRAPH if not after else kinds[skip + n] if safe[skip + n] else NONE
    cuts, kind = np.append(place[at], place[-1]), np.append(kinds[skip + at], last).astype(np.uint8)
    steps = np.diff(cuts, prepend=0)
    if (steps > LONGEST).any():  # runs without a safe place: cut between characters, at a token's end if there is one
        starts = place[np.isin(place, token_end)]
        extra = []
        for i in np.flatnonzero(steps > LONGEST):
            pos, stop = int(cuts[i] - steps[i]), int(cuts[i])
            while stop - pos > LONGEST:
                j = np.searchsorted(starts, pos + LONGEST, "right") - 1
                if j < 0 or starts[j] <= pos:
                    j2 = np.searchsorted(place, pos + LONGEST, "right") - 1
                    pos = int(place[j2])
                else:
                    pos = int(starts[j])
                extra.append(pos)
        order = np.argsort(np.concatenate([cuts, extra]), kind="stable")
        cuts = np.concatenate([cuts, np.array(extra, np.int64)])[order]
        kind = np.concatenate([kind, np.zeros(len(extra), np.uint8)])[order]
        steps = np.diff(cuts, prepend=0)
    tokens = np.searchsorted(token_end, cuts, "right") - 1
    tokens[-1] = len(token_end) - 1
    return np.stack([steps, np.diff(tokens, prepend=0), kind]).astype(np.uint8)


class Planner:
    """Plans the pieces of one text from its cut tables, fed in order; holds about one piece."""

    def __init__(self, limit: int, overlap: int, at: int = 0, part: bool = False):
        self.limit, self.overlap, self.part = limit, overlap, part
        self.bytes = np.full(1, at, np.int64)  # cut points since the piece's start, absolute
        self.tokens = np.zeros(1, np.int64)
        self.kinds = np.full(1, PARAGRAPH, np.uint8)
        self.fresh = 0  # tokens already in the piece before
        self.pieces: list[tuple[int, int, int, int]] = []
        self.total = 0

    def feed(self, table: np.ndarray) -> None:
        if not table.shape[1]:
            return
        step = np.cumsum(table[:2].astype(np.int64), axis=1)
        self.total += int(step[1, -1])
        self.bytes = np.concatenate([self.bytes, self.bytes[-1] + step[0]])
        self.tokens = np.concatenate([self.tokens, self.tokens[-1] + step[1]])
        self.kinds = np.concatenate([self.kinds, table[2]])
        while self.tokens[-1] - self.tokens[0] > self.limit + 2 * SLACK:
            self._cut()

    def _cut(self) -> None:
        start = self.tokens[0]
        room = self.limit - (SLACK if self.kinds[0] == NONE else 0)
        hi = max(1, int(np.searchsorted(self.tokens, start + room, "right")) - 1)
        lo = int(np.searchsorted(self.tokens, start + max(room * FILL, self.overlap + 1), "left"))
        lo = min(max(lo, 1), hi)
        window = self.kinds[lo : hi + 1]
        best = hi - int(window[::-1].argmax())
        if self.kinds[best] == NONE:
            best = max(1, int(np.searchsorted(self.tokens, start + room - SLACK, "right")) - 1)
        self._emit(best)
        back = self._back(best)
        self.fresh = int(self.tokens[best] - self.tokens[back])
        self.bytes, self.tokens, self.kinds = self.bytes[back:], self.tokens[back:], self.kinds[back:]

    def _back(self, cut: int) -> int:
        """Where the next piece starts: the strongest place that shares nearly ``overlap`` tokens."""
        if not self.overlap:
            return cut
        first = int(np.searchsorted(self.tokens, self.tokens[cut] - self.overlap, "left"))
        last = int(np.searchsorted(self.tokens, self.tokens[cut] - 0.875 * self.overlap, "right")) - 1
        first = min(max(first, 1), cut)
        last = min(max(last, first), cut)
        return first + int(self.kinds[first : last + 1].argmax())

    def _emit(self, end: int) -> None:
        self.pieces.append((int(self.bytes[0]), int(self.bytes[end]), int(self.tokens[end] - self.tokens[0]), self.fresh))

    def begin(self, tables: np.ndarray, cut: int) -> None:
        """Start at a cut point of the given tables, with the overlap that lies before it."""
        step = np.cumsum(tables[:2].astype(np.int64), axis=1)
        self.bytes = np.concatenate([self.bytes, self.bytes[-1] + step[0]])
        self.tokens = np.concatenate([self.tokens, step[1]])
        self.kinds = np.concatenate([np.zeros(1, np.uint8), tables[2]])
        back = self._back(cut)
        self.fresh = int(self.tokens[cut] - self.tokens[back])
        self.bytes, self.tokens, self.kinds = self.bytes[back : cut + 1], self.tokens[back : cut + 1], self.kinds[back : cut + 1]

    def drain(self) -> list[tuple[int, int, int, int]]:
        out, self.pieces = self.pieces, []
        return out

    def finish(self) -> list[tuple[int, int, int, int]]:
        """(start byte, end byte, tokens, tokens shared with the piece before) of the pieces not drained yet."""
        if self.total > self.limit or self.part:
            while self.tokens[-1] - self.tokens[0] > self.limit - (SLACK if self.kinds[0] == NONE else 0):
                self._cut()
            if self.tokens[-1] - self.tokens[0] > self.fresh:
                self._emit(len(self.tokens) - 1)
        return self.drain()


def plan(text: str, tok, limit: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """The pieces of one text in memory; none if it is within the limit."""
    p = Planner(limit, overlap)
    p.feed(cut_table(text, tok))
    return p.finish()


def range_table(head: bytes, body: bytes, tail: bytes, tok) -> tuple[int, bytes]:
    """Cut table of one range, from the first safe seam at or after its start to that of the next range, and how far off it begins."""
    data = head + body + tail
    start = _seam(data, len(head)) if head else 0
    end = _seam(data, len(head) + len(body)) if tail else len(data)
    if end <= start:
        return 0, b""
    text, before, after = data[start:end].decode("utf-8", "replace"), data[:start].decode("utf-8", "ignore"), data[end:].decode("utf-8", "ignore")
    return start - len(head), cut_table(text, tok, before, after).tobytes()


def text_ranges(documents: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """``(id, range, head, body, tail)`` of the texts that can exceed the limit."""
    b = F.col("_b")
    at = F.col("range") * RANGE_BYTES
    # A slice of bytes is taken in place; the text is not decoded.
    sub = lambda start, length: F.substring(b, (start + 1).cast("int"), length)
    return (
        documents.where(F.octet_length(text_col) > limit)
        .select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("_b"))
        .withColumn("range", F.explode(F.sequence(F.lit(0), ((F.octet_length("_b") - 1) / RANGE_BYTES).cast("int"))))
        .select(
            "id", "range",
            F.when(F.col("range") > 0, sub(at - BEFORE, F.lit(BEFORE))).otherwise(F.lit(b"")).alias("head"),
            sub(at, F.lit(RANGE_BYTES)).alias("body"), sub(at + RANGE_BYTES, F.lit(HALO)).alias("tail"),
        )
    )


def _opened(path: str):
    """File system and path of a name; any scheme that Arrow knows (file, hdfs, s3, gs) or none."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def file_ranges(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(id, range, size)``: the ranges of files, planned from their sizes; read by the workers where the files lie."""
    rows = []
    for p in paths:
        system, name = _opened(p)
        rows.append((p, system.get_file_info(name).size))
    files = spark.createDataFrame(rows, "id string, size long").where("size > 0")
    return files.select("id", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / range_bytes).cast("int"))).alias("range")).repartition("id", "range")


def _table_rows(rows, ids, ranges, range_bytes: int, tok) -> pa.RecordBatch:
    """Rows of ``(id, range, at, table)``; ``rows``: (head, body, tail) of each range."""
    found = [range_table(h, b, t, tok) for h, b, t in rows]
    at = [r * range_bytes + off for r, (off, _) in zip(ranges.to_pylist(), found)]
    return pa.RecordBatch.from_arrays([ids, ranges, pa.array(at, pa.int64()), pa.array([t for _, t in found], pa.binary())], ["id", "range", "at", "table"])


def boundary_tables(ranges: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id, range, at, table)`` from ranges with their bytes; ``at``: where the table begins."""
    kind = dict(ranges.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        for batch in batches:
            yield _table_rows(zip(*(batch.column(c).to_pylist() for c in ("head", "body", "tail"))), batch.column("id"), batch.column("range"), RANGE_BYTES, tok)

    return ranges.mapInArrow(work, f"id {kind}, range int, at long, table binary")


def file_boundary_tables(ranges: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As :func:`boundary_tables` for files: each worker seeks to its range; no file is read as a whole."""

    def read(path: str, r: int) -> tuple[bytes, bytes, bytes]:
        system, name = _opened(path)
        with system.open_input_file(name) as f:
            f.seek(max(0, r * range_bytes - BEFORE))
            head = f.read(BEFORE) if r else b""
            return head, f.read(range_bytes), f.read(HALO)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        for batch in batches:
            rows = (read(p, r) for p, r in zip(batch.column("id").to_pylist(), batch.column("range").to_pylist()))
            yield _table_rows(rows, batch.column("id"), batch.column("range"), range_bytes, tok)

    return ranges.select("id", "range").mapInArrow(work, "id string, range int, at long, table binary")


def part_boundary(table: np.ndarray) -> int:
    """The cut point of a part's first range at which the part begins: the first of the strongest."""
    return int(table[2].argmax()) + 1 if table.shape[1] else 0


def stitch(tables: DataFrame, limit: int, overlap: int, part_ranges: int = PART_RANGES) -> DataFrame:
    """``(id, part, piece, start, end, tokens, shared)``: the pieces of every text of more than ``limit`` tokens, in bytes.

    Pieces are numbered within parts; a text of at most ``part_ranges`` ranges is one part.
    """
    kind = dict(tables.dtypes)["id"]
    names = ["id", "part", "piece", "start", "end", "tokens", "shared"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, out = None, []
        current, planner, no, before = None, None, 0, []

        def take(found):
            nonlocal no
            for p in found:
                out.append((*current, no, *p))
                no += 1

        def batch_of(rows):
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            types = types or [batch.column("id").type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            for key, part, r, at, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "range", "at", "table"))):
                table = np.frombuffer(raw, np.uint8).reshape(3, -1)
                if (key, part) != current:
                    if planner is not None:
                        take(planner.finish())
                    current, planner, no, before = (key, part), None, 0, []
                if r < part * part_ranges:  # before the part: for the overlap
                    before.append((at, table))
                    continue
                if planner is None:
                    start = before[0][0] if before else at
                    planner = Planner(limit, overlap, start, part > 0)
                    if part:
                        cut = part_boundary(table)
                        lead = np.concatenate([*(t for _, t in before), table], axis=1)
                        ahead = sum(t.shape[1] for _, t in before)
                        planner.begin(lead[:, : ahead + cut], ahead + cut)
                        table = table[:, cut:]
                elif r >= (part + 1) * part_ranges:  # up to where the next part begins
                    table, planner.part = table[:, : part_boundary(table)], True
                planner.feed(table)
                take(planner.drain())
            if out:
                yield batch_of(out)
                out = []
        if planner is not None:
            take(planner.finish())
            yield batch_of(out)

    last = 1 + overlap * 16 // RANGE_BYTES  # ranges before a part, for its overlap
    own = lambda r: (r / part_ranges).cast("int")
    r = F.col("range")
    # Its own part, the next one if it lies just before it, and the one before if it is the first of a part.
    parts = F.array_distinct(F.array(own(r), own(r + last), F.greatest(F.lit(0), own(r - F.lit(1)))))
    placed = tables.where(F.col("id").isNotNull()).withColumn("part", F.explode(parts))
    ordered = placed.repartition("id", "part").sortWithinPartitions("id", "part", "range")
    return ordered.mapInArrow(work, f"id {kind}, part int, piece int, start long, end long, tokens int, shared int")


def split_documents(documents: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Plan of the pieces of every document of more than ``limit`` tokens; ids must be unique."""
    return stitch(boundary_tables(text_ranges(documents, id_col, text_col, limit), tokenizer), limit, overlap)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, tokenizer: str = DEFAULT_TOKENIZER, range_bytes: int = RANGE_BYTES, part_ranges: int = PART_RANGES) -> DataFrame:
    return stitch(file_boundary_tables(file_ranges(spark, paths, range_bytes), tokenizer, range_bytes), limit, overlap, part_ranges)


def with_text(documents: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 0) -> DataFrame:
    """The pieces with their text, cut out by byte offset; one small row per text is joined, not one per piece.

    Texts of at most ``limit`` bytes have no pieces and aren't moved.
    """
    per = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "start", "end", "tokens", "shared"))).alias("p"))
    texts = documents.where(F.octet_length(text_col) > limit).select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("_b"))
    cut = texts.join(per, "id").select("id", "_b", F.inline("p"))
    body = F.decode(F.substring("_b", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return cut.select("id", "part", "piece", "start", "end", "tokens", "shared", body.alias("text"))
