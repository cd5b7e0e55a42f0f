"""The k most similar vectors of every vector: inverted cells of randomly rotated one-bit codes.

* Centroids are fitted on the driver on a bounded sample (at most ``SAMPLE_MAX`` vectors, chosen by a hash of the
  id); every vector is indexed. There is a cell for every ``cell_rows`` vectors, however many these are: beyond
  ``SINGLE_MAX`` cells a cell is a pair of a coarse centroid and a centroid of the residuals, both fitted on the same
  sample, so that what is broadcast grows with the square root of the number of cells.
* A vector lies in the cell of its nearest coarse centroid and, in it, the nearest residual. It searches its own cell
  and all whose centroids are nearly as close, coarse and fine. How nearly is measured: for at most
  ``PROBES_MEASURED`` vectors, chosen by a hash, the true neighbours are found by brute force over all rows, and the
  margins (in cosine) are those that reach ``RECALL`` of them.
* In a cell each vector is one bit per rotated coordinate of its residual to the cell's mean, packed into words, with
  three correction scalars. A query is quantised to four bits per coordinate; and + popcount of its bit planes
  gives an estimate of the inner product with an error bound. Every vector whose upper bound reaches the k-th best
  lower bound is reranked by the exact cosine, so within the probed cells the loss is that of the bound only.

Only ``(cell, id, vector)`` rows are shuffled, about two per vector; each cell answers with k candidates per query.
Cells that hold more than ``BLOCKS_FROM`` times ``cell_rows`` vectors (all are counted) are split on both sides by
hashes of the id: each part of the queries meets each block of the indexed vectors in a task of its own. Vectors of
one direction, when they are more than ``COPIES_MAX``, leave the index except for the k + 1 of smallest id: their
cosine is 1 to six decimals, so the nearest of each are the first k others of the class.

Edge cases: null or blank ids and unusable vectors (wrong length, null, NaN or infinite entries, all zero) take no
part; repeated rows count once; a vector is never its own neighbour; equal similarities (cosine rounded to six
decimals) are decided by the smaller id; fewer than k others give fewer rows; an empty table gives an empty result;
rows of one id with different vectors are all searched and indexed; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage

SAMPLE_MAX = 65_536
SINGLE_MAX = 4_096
BLOCKS_FROM = 8
COPIES_MAX = 256
PROBES_MEASURED = 256
RECALL = 0.99
EPSILON = 1.9  # width of the error bound in standard deviations of the estimate
QUERY_BITS = 4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7, unit: bool = True) -> np.ndarray:
    """Centroids by k-means: of unit vectors by cosine, else by distance."""
    c = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        half = 0 if unit else (c**2).sum(1) / 2
        best = np.concatenate([(sample[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(sample), 4096)])
        order = np.argsort(best, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
        sums = np.add.reduceat(sample[order], starts, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True) if unit else np.diff(np.r_[starts, len(order)])[:, None]
        c[best[order][starts]] = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c[best[order][starts]])
    return c.astype(np.float32)


class Cells:
    """The centroids: one level, or coarse ones and those of the residuals. A cell's number is coarse * fine + fine."""

    def __init__(self, sample: np.ndarray, cells: int, single: int, dim: int):
        cells = max(1, min(cells, len(sample) // 4) if cells <= single else cells)
        # Coarse centroids divide better, so there are as many as a vector can be compared with at little cost.
        first = cells if cells <= single else int(max(np.ceil(np.sqrt(cells)), min(cells, single) // 4))
        self.coarse = fit_cells(sample, first) if first > 1 else np.zeros((1, dim), np.float32)
        self.fine = np.zeros((1, dim), np.float32)
        if cells > single:
            self.fine = fit_cells(sample - self.coarse[(sample @ self.coarse.T).argmax(1)], -(-cells // first), unit=False)
        self.length = np.sqrt(np.maximum((self.coarse**2).sum(1)[:, None] + 2 * self.coarse @ self.fine.T + (self.fine**2).sum(1), 1e-12)).astype(np.float32)
        self.margins = (2.0, 2.0)
        self.step = 2048 if len(self.fine) == 1 else int(np.clip(500_000 // len(self.fine), 16, 2048))  # rows at once
        self.hot, self.blocks = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def home(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, its cosine, similarity to all coarse, to all residual centroids) of each vector."""
        s1, s2 = unit @ self.coarse.T, unit @ self.fine.T
        c = s1.argmax(1)
        at = np.arange(len(unit))
        inner = (s1[at, c][:, None] + s2) / self.length[c]
        f = inner.argmax(1)
        return c * len(self.fine) + f, inner[at, f], s1, s2

    def probes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is the row's own) of all cells to search."""
        home, best, s1, s2 = self.home(unit)
        r, c = np.nonzero(s1 >= s1.max(1, keepdims=True) - self.margins[0])
        if len(self.fine) == 1:
            return r, c, home[r] == c
        at, f = np.nonzero((s1[r, c][:, None] + s2[r]) / self.length[c] >= (best[r] - self.margins[1])[:, None])
        r, cell = r[at], c[at] * len(self.fine) + f
        return r, cell, home[r] == cell

    def split(self, cell: np.ndarray) -> np.ndarray:
        """In how many parts each cell is split."""
        if not len(self.hot):
            return np.ones(len(cell), np.int64)
        at = np.minimum(np.searchsorted(self.hot, cell), len(self.hot) - 1)
        return np.where(self.hot[at] == cell, self.blocks[at], 1)


def _pack(bits: np.ndarray) -> np.ndarray:
    b = np.packbits(bits, axis=1)
    if pad := -b.shape[1] % 8:
        b = np.pad(b, ((0, 0), (0, pad)))
    return b.view(np.uint64)


class Cell:
    """One-bit codes and correction scalars of the vectors of one cell, relative to their mean ``c``.

    A vector's cosine with a query is ``n * m * <u, v> + <o, c> + <q, c> - <c, c>`` with the residuals ``n u`` and
    ``m v``; ``<u, v>`` is estimated from the code of ``u`` and the quantised ``v`` and divided by ``<code, u>``.
    """

    def __init__(self, vectors: np.ndarray, rotate: np.ndarray):
        self.dim, self.rotate = vectors.shape[1], rotate
        self.exact = vectors.astype(np.float64)
        self.exact /= np.linalg.norm(self.exact, axis=1, keepdims=True)
        self.unit = self.exact.astype(np.float32)
        self.centroid = centroid = self.unit.mean(0)
        res = self.unit - centroid
        norm = np.maximum(np.linalg.norm(res, axis=1), 1e-7)
        turned = (res / norm[:, None]) @ rotate
        self.codes = np.ascontiguousarray(_pack(turned > 0).T)
        ones = np.bitwise_count(self.codes).sum(0).astype(np.float32)
        cos = np.abs(turned).sum(1) / np.sqrt(self.dim)
        self.scale = (norm / (np.sqrt(self.dim) * cos)).astype(np.float32)
        error = EPSILON * norm * np.sqrt(np.maximum(1 - cos**2, 0)) / cos / np.sqrt(max(self.dim - 1, 1))
        #: Rows that the per-query scalars of ``upper`` are multiplied with.
        self.terms = np.stack([ones * self.scale, self.scale, error, self.unit @ centroid, np.ones(len(norm))]).astype(np.float32)

    def upper(self, unit: np.ndarray, room: tuple[np.ndarray, ...]) -> np.ndarray:
        """Upper bound of the cosine of each query with each vector; ``room``: buffers of that shape."""
        word, count, total, out = (x[: len(unit)] for x in room)
        res = unit - self.centroid
        norm = np.maximum(np.linalg.norm(res, axis=1), 1e-7)
        turned = (res / norm[:, None]) @ self.rotate
        low = turned.min(1)
        step = np.maximum(turned.max(1) - low, 1e-6) / (2**QUERY_BITS - 1)
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        total[:] = 0
        for j in reversed(range(QUERY_BITS)):
            total += total
            plane = _pack((levels >> j) & 1)
            for w, codes in enumerate(self.codes):
                np.bitwise_and(plane[:, w, None], codes, out=word)
                np.bitwise_count(word, out=count)
                total += count
        np.multiply(total, self.scale, out=out)
        out *= (2 * step * norm).astype(np.float32)[:, None]
        # Rounding a query moves its product with a code by about step * sqrt(dim / 12).
        rounding = EPSILON * step * np.sqrt(self.dim / 12)
        scalars = np.stack([2 * low * norm, (rounding - turned.sum(1)) * norm, norm, np.ones(len(norm)), unit @ self.centroid - self.centroid @ self.centroid + 1e-5], axis=1)
        out += scalars.astype(np.float32) @ self.terms
        return out

    def search(self, queries: np.ndarray, k: int, parts: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, cosine) of every vector whose bound reaches the k-th best known exact cosine.

        The best estimate of each of some equal parts of the cell is compared exactly first; the k + 1 best of these
        (a query may be among them itself) give the bar for all others.
        """
        q64 = queries.astype(np.float64)
        q64 /= np.linalg.norm(q64, axis=1, keepdims=True)
        m = self.codes.shape[1]
        block = int(np.clip(48_000 // m, 8, 64))  # the buffers stay in the processor's cache
        parts = max(parts, 2 * (k + 1))
        width = -(-m // parts)
        spans = [(a, min(a + width, m)) for a in range(0, m, width)]
        room = tuple(np.empty((block, m), t) for t in (np.uint64, np.uint8, np.uint16, np.float32))
        rows, cols, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(0, len(q64), block):
            part = q64[i : i + block]
            unit = part.astype(np.float32)
            if len(spans) > k + 1:
                bound = self.upper(unit, room)
                lead = np.stack([bound[:, a:b].argmax(1) + a for a, b in spans], axis=1)
                known = np.einsum("ij,ikj->ik", unit, self.unit[lead])
                bar = np.partition(known, len(spans) - k - 1, axis=1)[:, len(spans) - k - 1] - 1e-5
                at = np.flatnonzero(bound >= bar[:, None])
                r, c = at // m, at % m
                near = np.einsum("ij,ij->i", unit[r], self.unit[c]) >= bar[r]  # the bar has room for rounding
                r, c = r[near], c[near]
            else:
                r, c = np.divmod(np.arange(len(part) * m), m)
            rows.append(r + i)
            cols.append(c)
            sims.append(np.einsum("ij,ij->i", part[r], self.exact[c]))
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def nearest_in_cell(ids_q, queries, ids, vectors, rotate, k) -> tuple[list, list, np.ndarray]:
    """(query ids, neighbour ids, cosine rounded to 6): the k best of one cell for each query; repeated ids count once."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    first = np.r_[True, (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(1)] if len(ids) else np.zeros(0, bool)
    ids, vectors = ids[first], vectors[first]
    r, c, s = Cell(vectors, rotate).search(queries, k)
    other = ids_q[r] != ids[c]
    r, c, s = r[other], c[other], np.round(s[other], 6)
    keep = _ranked(r, c, s, k)
    return ids_q[r[keep]], ids[c[keep]], s[keep]


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    v = F.col(vec_col)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull()).where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), v.cast("array<float>").alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _units(vecs: np.ndarray) -> np.ndarray:
    return (vecs / np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


BOTH, QUERY, INDEXED = 0, 1, 2


def nearest(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec", k: int = 3, dim: int = 64, cell_rows: int = 1024, recall: float = RECALL, single: int = SINGLE_MAX) -> DataFrame:
    """``(id, neighbour, similarity)``: the k most similar vectors of every usable vector."""
    rows, copies, n = _set_copies_aside(usable_vectors(vectors, id_col, vec_col, dim), k, dim)
    cells = place_cells(rows, n, k, dim, cell_rows, recall, single)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def assign(batches):
        cells = shared.value
        for batch in batches:
            vecs = _matrix(batch.column("vec"), dim)
            if not len(vecs):
                continue
            ids, salt = batch.column("id"), batch.column("salt").to_numpy(zero_copy_only=False)
            unit = _units(vecs)
            out = [[], [], [], [], []]
            for i in range(0, len(unit), cells.step):
                r, c, own = cells.probes(unit[i : i + cells.step])
                many, x = cells.split(c), salt[i + r]
                whole = many == 1
                # A query of a split cell goes to each of its blocks, an indexed vector to each part of the queries.
                for rows_, role in ((whole, np.where(own, BOTH, QUERY)), (~whole, QUERY), (~whole & own, INDEXED)):
                    at = np.flatnonzero(rows_)
                    at = np.repeat(at, many[at])
                    j = np.arange(len(at)) - np.searchsorted(at, at)
                    mine = (x[at] >> 20) % many[at] if np.ndim(role) == 0 and role == QUERY else x[at] % many[at]
                    block, part = (mine, j) if np.ndim(role) == 0 and role == INDEXED else (j, mine)
                    block, part = (block, part) if np.ndim(role) == 0 else (0 * at, 0 * at)
                    for o, y in zip(out, (r[at] + i, c[at], block, part, role[at] if np.ndim(role) else np.full(len(at), role))):
                        o.append(y)
            r, c, b, p, role = (np.concatenate(o) for o in out)
            raw = vecs[r].tobytes()
            offsets = np.arange(0, (len(r) + 1) * dim * 4, dim * 4, dtype=np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.int32()), pa.array(p, pa.int32()), pa.array(role, pa.int32()), ids.take(pa.array(r)), binary], ["cell", "block", "part", "role", "id", "vec"])

    def search(key, group):
        group = group.combine_chunks()
        vecs = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        ids = np.array(group.column("id").to_pylist(), dtype=object)
        role = group.column("role").to_numpy(zero_copy_only=False)
        mine, asks = role != QUERY, np.flatnonzero(role != INDEXED)
        if not mine.any() or not len(asks):
            return pa.table({"id": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        order = asks[np.argsort(ids[asks], kind="stable")]
        same = np.r_[False, (ids[order][1:] == ids[order][:-1]) & (vecs[order][1:] == vecs[order][:-1]).all(1)]
        q = np.sort(order[~same])
        a, b, s = nearest_in_cell(ids[q], vecs[q], ids[mine], vecs[mine], rotation(dim), k)
        return pa.table({"id": pa.array(a, pa.string()), "neighbour": pa.array(b, pa.string()), "similarity": pa.array(s, pa.float64())})

    placed = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("salt")).mapInArrow(assign, "cell long, block int, part int, role int, id string, vec binary")
    found = placed.groupBy("cell", "block", "part").applyInArrow(search, "id string, neighbour string, similarity double")
    best = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("d"), F.col("neighbour").alias("n")))).alias("c"))
    once = F.filter("c", lambda x, i: ~F.exists(F.slice("c", 1, i), lambda y: y["n"] == x["n"]))
    out = best.select("id", F.inline(F.slice(once, 1, k))).select("id", F.col("n").alias("neighbour"), (-F.col("d")).alias("similarity"))
    return out if copies is None else out.unionByName(copies)


def place_cells(rows: DataFrame, n: int, k: int, dim: int, cell_rows: int, recall: float = RECALL, single: int = SINGLE_MAX) -> Cells:
    """The cells for ``n`` rows ``(id, vec)``, with margins and with the parts that the large ones are split in."""
    wanted = max(1, n // cell_rows)
    every = max(1, -(-n // SAMPLE_MAX)) if wanted > single else max(1, -(-n // min(SAMPLE_MAX, 64 * wanted)))
    # Residue 0 is the sample; of residue 1, so that they are not what the centroids were fitted to, come the vectors
    # whose neighbours are found by brute force.
    part = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(every))
    few = F.pmod(F.xxhash64(F.lit("probe"), "id"), F.lit(max(1, n // every // PROBES_MEASURED))) == 0
    probe = (part == 1 % every) & few
    picked = rows.where((part == 0) | probe).select("vec", (part == 0).alias("s"), probe.alias("p")).limit(2 * SAMPLE_MAX).toArrow()

    def units(flag: str, most: int) -> np.ndarray:
        x = picked.filter(picked[flag])["vec"]
        return _units(_matrix(x, dim)[:most]) if len(x) else np.zeros((0, dim), np.float32)

    cells = Cells(units("s", SAMPLE_MAX), wanted, single, dim)
    large = BLOCKS_FROM * cell_rows
    loads = measure(cells, rows, units("p", 2 * PROBES_MEASURED), k, dim, recall, large) if len(cells) > 1 else [(0, n)]
    cells.hot, cells.blocks = np.array([(c, -(-x // large)) for c, x in sorted(loads)], np.int64).reshape(-1, 2).T
    return cells


def measure(cells: Cells, rows: DataFrame, queries: np.ndarray, k: int, dim: int, recall: float, large: int) -> list[tuple[int, int]]:
    """Sets the margins within which ``recall`` of the neighbours lie; gives the cells of more than ``large`` vectors.

    Each task answers with its k + 1 best for each query (one may be the query itself), as cosine and the distances of
    their cells, and with the number of its vectors in each cell.
    """
    spark = rows.sparkSession
    home, best, s1, s2 = cells.home(queries) if len(queries) else (None,) * 4
    shared = spark.sparkContext.broadcast((cells, queries, best, s1, s2))

    def work(batches):
        cells, q, best, s1, s2 = shared.value
        top = np.full((len(q), k + 1, 3), -9.0)
        loads = {}
        for batch in batches:
            vecs = _matrix(batch.column("vec"), dim)
            if not len(vecs):
                continue
            unit = _units(vecs)
            own = np.concatenate([cells.home(unit[i : i + cells.step])[0] for i in range(0, len(unit), cells.step)])
            for c, m in zip(*(x.tolist() for x in np.unique(own, return_counts=True))):
                loads[c] = loads.get(c, 0) + m
            if len(q):
                sim = q @ unit.T
                near = np.argpartition(-sim, min(k, len(unit) - 1), axis=1)[:, : k + 1]
                at = np.arange(len(q))[:, None]
                c, f = np.divmod(own[near], len(cells.fine))
                inner = (s1[at, c] + s2[at, f]) / cells.length[c, f]
                new = np.stack([sim[at, near], s1.max(1, keepdims=True) - s1[at, c], best[:, None] - inner], axis=2)
                both = np.concatenate([top, new], axis=1)
                top = np.take_along_axis(both, np.argsort(-both[:, :, 0], axis=1)[:, : k + 1, None], axis=1)
        at, j = np.nonzero(top[:, :, 0] > -9)
        x = top[at, j]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(str), pa.string()), *[pa.array(x[:, i], pa.float64()) for i in range(3)], none, none], ["q", "s", "coarse", "fine", "cell", "n"])
        none = [pa.nulls(len(loads), pa.float64())] * 3
        yield pa.RecordBatch.from_arrays([pa.nulls(len(loads), pa.string()), *none, pa.array(list(loads), pa.int64()), pa.array(list(loads.values()), pa.int64())], ["q", "s", "coarse", "fine", "cell", "n"])

    from weftline.llm.topn import top_n

    answers = cut_lineage(rows.select("vec").mapInArrow(work, "q string, s double, coarse double, fine double, cell long, n long"))
    loads = answers.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > large).collect()
    # The best is the query itself, whose margins are zero.
    ranked = top_n(answers.where("q IS NOT NULL").withColumn("i", F.concat_ws("|", "coarse", "fine")), "q", "s", "i", k + 1, keep=["coarse", "fine"]).where("rank > 1")
    gaps = np.array([(r.coarse, r.fine) for r in ranked.select("coarse", "fine").collect()])
    if len(gaps):
        for share in np.linspace(recall, (1 + recall) / 2, 11):  # the least at which enough lie within both
            margins = np.maximum(np.quantile(gaps, share, axis=0), 0) + 1e-6
            if (gaps <= margins).all(1).mean() >= recall:
                break
        cells.margins = tuple(margins.tolist())
    return [(r.cell, r.n) for r in loads]


def _directions(dim: int):
    """Adds ``h``: equal for vectors of one direction, whose cosine is 1 to six decimals whatever the dimension."""
    grid = np.float64(8e-4) / np.sqrt(dim)  # vectors of one grid cell are at most 8e-4 apart

    def work(batches):
        for batch in batches:
            vecs = _matrix(batch.column("vec"), dim).astype(np.float64)
            vecs /= np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
            steps = np.ascontiguousarray(np.floor(vecs / grid).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_row_hash(steps), pa.int64())], [*batch.schema.names, "h"])

    return work


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of integers."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(rows.shape[1]):
        h ^= rows[:, j].astype(np.int64).view(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _set_copies_aside(rows: DataFrame, k: int, dim: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Leave k + 1 members of every large class of vectors of one direction in the index.

    Gives the rows to index, the neighbours of the others if there are any, and the number of rows.
    """
    from weftline.llm.topn import top_n

    keyed = rows.mapInArrow(_directions(dim), "id string, vec array<float>, h long").select("id", "h")
    classes = keyed.groupBy("h").count()
    n, found = classes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > COPIES_MAX)).first()
    if not found:
        return rows, None, n
    large = classes.where(F.col("count") > COPIES_MAX).select("h")
    large = F.broadcast(large) if found <= 10_000 else large
    members = keyed.join(large, "h").distinct()
    first = top_n(members.withColumn("s", F.lit(0.0)), "h", "s", "id", k + 1).groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    first = cut_lineage(first.where(F.size("ids") > k))  # fewer ids than k + 1: one record many times
    first = F.broadcast(first) if found <= 10_000 else first
    joined = rows.mapInArrow(_directions(dim), "id string, vec array<float>, h long").join(first, "h", "left")
    spare = F.col("ids").isNotNull() & ~F.array_contains("ids", F.col("id"))
    copies = joined.where(spare).select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity")).distinct()
    return joined.where(F.col("ids").isNull() | F.array_contains("ids", F.col("id"))).select("id", "vec"), copies, n


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Each pair once, smaller id first."""
    return found.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()


def _ranked(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (similarity, then smaller c) of each r."""
    order = np.lexsort((c, -s, r))
    r = r[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[rank < k]


def exact_neighbours(rows: DataFrame, queries: DataFrame, k: int, dim: int, block: int = 4096) -> DataFrame:
    """``(id, neighbour, similarity)`` of the queries against all rows by brute force, in blocks of queries."""
    from weftline.llm.topn import top_n

    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        names = np.array(part["id"].to_pylist(), dtype=object)
        unit = _matrix(part["vec"], dim).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((names, unit))

        def work(batches, shared=shared):
            names, q = shared.value
            for batch in batches:
                x = _matrix(batch.column("vec"), dim).astype(np.float64)
                if not len(x):
                    continue
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                ids = np.array(batch.column("id").to_pylist(), dtype=object)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                first = np.r_[True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)]
                ids, x = ids[first], x[first]
                for i in range(0, len(q), 256):
                    s = np.round(q[i : i + 256] @ x.T, 6)
                    most = min(k + 1, s.shape[1])  # one may be the query itself
                    bar = -np.partition(-s, most - 1, axis=1)[:, most - 1]
                    r, c = np.nonzero(s >= bar[:, None])
                    other = names[r + i] != ids[c]
                    r, c = r[other], c[other]
                    keep = _ranked(r, c, s[r, c], k)
                    r, c = r[keep], c[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(names[r + i], pa.string()), pa.array(ids[c], pa.string()), pa.array(s[r, c])], ["id", "neighbour", "similarity"])

        one = rows.mapInArrow(work, "id string, neighbour string, similarity double").distinct()
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    return top_n(out, "id", "similarity", "neighbour", k).select("id", "neighbour", "similarity")


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``(queries, neighbours, found, recall)`` of the exact neighbours that the index gives as well."""
    hit = exact.select("id", "neighbour").join(found.select("id", "neighbour", F.lit(1).alias("h")), ["id", "neighbour"], "left")
    return hit.agg(F.countDistinct("id").alias("queries"), F.count("*").alias("neighbours"), F.count("h").alias("found")).withColumn("recall", F.try_divide(F.col("found").cast("double"), F.col("neighbours")))


def brute_force(ids: list[str], vectors: np.ndarray, k: int) -> set[tuple[str, str, float]]:
    """Reference answer for tests and recall, in blocks."""
    order = np.argsort(np.array(ids, dtype=object), kind="stable")
    names = np.array(ids, dtype=object)[order]
    unit = vectors[order].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = set()
    for i in range(0, len(unit), 512):
        s = np.round(unit[i : i + 512] @ unit.T, 6)
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        for r, cols in enumerate(top):
            out |= {(names[i + r], names[c], float(s[r, c])) for c in cols if c != i + r and s[r, c] > -5}
    return out
