"""Filling fixed-capacity containers: conflict-constrained best-fit.

Every text becomes an item of its token count; a text that alone exceeds a container is cut into pieces at natural
boundaries first. Items are spread by a hash over shards of about ``SHARD_TOKENS`` tokens, so that every shard is one
bounded task whatever the skew of sources, and each shard is packed by best-fit in falling size:

* open bins are ordered by residual: a tree over the residuals has a bitmap of the bins at and below each node;
* for each duplicate cluster and source there is a bitmap of the bins that hold it. Copies of one text never share a
  container; texts of one source share one only where no open container with room is free of that source, since
  little unused space comes first;
* the successor search starts at the item's size and goes on to larger residuals until the tightest compatible bin
  is found, first among those without the source, then among all; only if there is none a bin is opened.

A shard leaves about one container partly filled, whatever the number of documents.

Edge cases: a null text is no item; an empty text is an item of no tokens and takes no room; a null source has no
conflict; equal sizes are taken in the order of digest, id and piece; the same rows give the same containers on every run;
repeated ids are packed as separate items; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.splitting import plan
from weftline.llm.tokens import DEFAULT_TOKENIZER, load
from weftline.session import cut_lineage

SHARD_TOKENS = 4_000_000
MANY = 32


def items(documents: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source_id", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id, piece, start, end, tokens, source, cluster)``; the offsets are bytes of the text. No text is shuffled."""
    kind = dict(documents.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                n = tok.count(text)
                size = len(text.encode()) if n > capacity or len(text) < 8 else 0
                cuts = plan(text, tok, capacity) if n > capacity else []
                for p, (start, end, tokens, _) in enumerate(cuts or [(0, size or len(text.encode()), n, 0)]):
                    take.append(i)
                    rows.append((p, start, end, tokens))
            cols = list(zip(*rows)) if rows else [[]] * 4
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(index), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), batch.column("source").take(index), batch.column("cluster").take(index)],
                ["id", "piece", "start", "end", "tokens", "source", "cluster"],
            )

    rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.md5(F.col(text_col)).alias("cluster"))
    return rows.mapInArrow(work, f"id {kind}, piece int, start long, end long, tokens int, source string, cluster string")


def conflict_masks(*classes: Sequence[str | None]) -> list[int]:
    """One bitmap per item; only classes with two or more items need a bit."""
    masks, bit = [0] * len(classes[0]), 0
    for values in classes:
        bits = {}
        for v, n in Counter(v for v in values if v is not None).items():
            if n > 1:
                bits[v] = 1 << bit
                bit += 1
        masks = [m | bits.get(v, 0) for m, v in zip(masks, values)]
    return masks


def best_fit(sizes: Sequence[int], never: Sequence[int], rather_not: Sequence[int], capacity: int) -> list[int]:
    """Bin of each item, items taken in the given order; sizes are at most the capacity.

    ``never``: bitmaps of classes of which a bin holds one item at most; ``rather_not``: of classes that share a bin
    only where no open bin with room is free of them. Items of one class and size that follow one another, when they
    are many, are placed in one pass over the bins: a bin takes only one of them anyway.
    """
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)  # bitmaps of bins: a leaf has those of one residual, a node those of all leaves below
    holders: dict[tuple[bool, int], int] = defaultdict(int)  # bins that hold an item of a class
    classes: dict[tuple[bool, int], list[tuple[bool, int]]] = {}
    bins, where = 0, [0] * len(sizes)

    def keys(hard: bool, mask: int) -> list[tuple[bool, int]]:
        if (hard, mask) not in classes:
            classes[hard, mask] = [(hard, n) for n in _ones(mask)]
        return classes[hard, mask]

    def without(must: int, soft: int = 0) -> int:
        """Bitmap of the bins that hold no class of the masks."""
        out = 0
        for c in keys(True, must) + keys(False, soft):
            out |= holders[c]
        return ~out

    def tightest(level: int, allowed: int) -> int:
        """The lowest residual from ``level`` on that an allowed bin has, or -1."""
        n = level + leaves
        while not tree[n] & allowed:
            while n & 1:
                n >>= 1
            if not n:
                return -1
            n += 1
        while n < leaves:
            n <<= 1
            if not tree[n] & allowed:
                n += 1
        return n - leaves

    def fitting(size: int, allowed: int):
        """(level, bin) of the allowed bins, tightest first."""
        level = tightest(size, allowed)
        while level >= 0:
            for b in reversed(_ones(tree[level + leaves] & allowed)):
                yield level, b
            level = tightest(level + 1, allowed)

    def move(level: int, to: int, some: int) -> None:
        """Bins, as a bitmap, to another residual; a level of -1 is for new ones."""
        x, y = level + leaves if level >= 0 else 0, to + leaves
        while x != y:
            if x:
                tree[x] ^= some
            tree[y] ^= some
            x, y = x >> 1, y >> 1

    i = 0
    while i < len(sizes):
        size, must = sizes[i], never[i]
        end = i + 1
        while must and end < len(sizes) and never[end] == must and sizes[end] == size:
            end += 1
        if end - i > MANY:
            found, taken, moved, held = {}, set(), defaultdict(list), defaultdict(list)
            for k in range(i, end):
                level, b = -1, -1
                for soft in dict.fromkeys((rather_not[k], 0)):
                    if soft not in found:
                        found[soft] = fitting(size, without(must, soft))
                    level, b = next((x for x in found[soft] if x[1] not in taken), (-1, -1))
                    if b >= 0:
                        break
                if b < 0:
                    b, bins = bins, bins + 1
                taken.add(b)
                moved[level].append(b)
                held[rather_not[k]].append(b)
                where[k] = b
            for level, some in moved.items():
                move(level, (level if level >= 0 else capacity) - size, _bitmap(some))
            for c in keys(True, must):
                holders[c] |= _bitmap(taken)
            for soft, some in held.items():
                for c in keys(False, soft):
                    holders[c] |= _bitmap(some)
        else:
            for k in range(i, end):
                allowed = without(must, rather_not[k])
                level = tightest(size, allowed)
                if level < 0 and rather_not[k]:
                    allowed = without(must)
                    level = tightest(size, allowed)
                if level < 0:
                    b, bins = bins, bins + 1
                else:
                    b = (tree[level + leaves] & allowed).bit_length() - 1
                move(level, (level if level >= 0 else capacity) - size, 1 << b)
                for c in keys(True, must) + keys(False, rather_not[k]):
                    holders[c] |= 1 << b
                where[k] = b
        i = end
    return where


def _ones(mask: int) -> list[int]:
    """Places of the bits that are set."""
    return [n for n, c in enumerate(bin(mask)[:1:-1]) if c == "1"]


def _bitmap(places: Collection[int]) -> int:
    out = bytearray(max(places) // 8 + 1)
    for n in places:
        out[n >> 3] |= 1 << (n & 7)
    return int.from_bytes(out, "little")


def pack(item_rows: DataFrame, capacity: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(container_id, id, piece, start, end, tokens)`` for every item."""
    kind = dict(item_rows.dtypes)["id"]
    item_rows = cut_lineage(item_rows)  # a few bytes per text; it is read twice
    total = item_rows.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-int(total) // max(shard_tokens, capacity)))

    def work(key, group):
        group = group.sort_by([("tokens", "descending"), ("cluster", "ascending"), ("id", "ascending"), ("piece", "ascending")])
        bins = best_fit(group["tokens"].to_pylist(), conflict_masks(group["cluster"].to_pylist()), conflict_masks(group["source"].to_pylist()), capacity)
        shard = key[0].as_py()
        names = pa.array([f"{shard:06d}-{b:06d}" for b in bins], pa.string())
        return pa.table([names, *(group[c] for c in ("id", "piece", "start", "end", "tokens"))], ["container_id", "id", "piece", "start", "end", "tokens"])

    sharded = item_rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), "id", "piece"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(work, f"container_id string, id {kind}, piece int, start long, end long, tokens int")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, items, tokens and the share of room that is used."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count("*") * F.lit(capacity))).alias("fill"))
