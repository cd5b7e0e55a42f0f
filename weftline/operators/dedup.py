"""Entity de-duplication: exact keys, edit distance, cosine.

Edit distance: two strings within few edits share one of their rarest grams, so candidates come from an equi-join; for
many edits blocks of strings are compared by tries. Both are exact. Cosine: cells that the angle of the threshold rules out
aren't visited. Records equal in all that is compared are one class; pairs are between classes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.similarity import similarity_tier, structural_similarity, tier_action
from weftline.functions.text import normalize_text, strip
from weftline.operators import near
from weftline.operators.ranking import top_in_group
from weftline.session import cut_lineage, ship_path, work_folder

QUOTES = 5
GRAM_BLOCK = 250
NAME_BLOCK = 8192
FEW_EDITS = 0.7
BROADCAST_ROWS = 50_000


def dedup_key(en: Column, jp: Column) -> Column:
    en, jp = strip(F.lower(F.coalesce(en, F.lit("")))), strip(F.lower(F.coalesce(jp, F.lit(""))))
    return F.when(en != "", en).when(jp != "", jp)


def union_sets(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, columns...)``: the sorted union of the arrays of each column. Entries are made distinct before they are
    gathered, so what a group holds is its result and not its rows."""
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(c, F.array().cast("array<string>")).alias("a")) for i, c in enumerate(columns)]))
    values = rows.select(key, one.alias("e")).select(key, F.col("e.i").alias("i"), F.explode_outer("e.a").alias("v")).distinct()
    return values.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("i") == i, F.col("v")))).alias(c) for i, c in enumerate(columns)])


def first_entries(rows: DataFrame, key: str, column: str, order: Column | str, n: int) -> DataFrame:
    """``(key, column)``: the first ``n`` different entries of an array column, by row order and place."""
    order = F.col(order) if isinstance(order, str) else order
    each = rows.select(key, order.alias("_o"), F.posexplode(column).alias("_p", "_v")).where("_v IS NOT NULL")
    seen = each.groupBy(key, "_v").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    top = top_in_group(seen, key, [F.col("_at")], n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_v"))), lambda x: x["_v"]).alias(column))


def deduplicate(concepts: DataFrame, order: str, scalars: tuple[str, ...], sets: tuple[str, ...], quotes: str | None = None) -> DataFrame:
    """One row per key (English, else Japanese name): scalars of the first row, sets united, quotes capped at 5.

    Sets come out sorted; quotes in first-seen order. Rows without a name are dropped.
    """
    keyed = concepts.withColumn("key", dedup_key(F.col("en_name"), F.col("jp_name"))).where("key IS NOT NULL")
    out = keyed.groupBy("key").agg(F.min_by(F.struct(*scalars), order).alias("_first"), F.count("*").alias("records"))
    out = out.join(union_sets(keyed, "key", sets), "key")
    if quotes:
        out = out.join(first_entries(keyed, "key", quotes, order, QUOTES), "key", "left").withColumn(quotes, F.coalesce(quotes, F.array().cast("array<string>")))
    return out.select("key", "_first.*", "records", *sets, *([quotes] if quotes else []))


def assign_ids(rows: DataFrame, order: str, prefix: str = "SCS-", width: int = 4, existing: DataFrame | None = None, id_col: str = "concept_id") -> DataFrame:
    """Sequential ids after the largest one in use, so that none is given twice.

    Numbers are given in two steps, per range partition and then by offsets, so no task sees all rows.
    """
    start = 0
    if existing is not None:
        start = existing.agg(F.max(F.regexp_extract(F.col(id_col), rf"^{prefix}(\d+)$", 1).try_cast("long"))).first()[0] or 0
    cut = rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    cut = cut_lineage(cut)  # the ranges are sampled: both uses must see the same
    sizes = cut.groupBy("_p").count().withColumn("_base", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_base", F.lit(0)).alias("_base"))
    n = F.row_number().over(Window.partitionBy("_p").orderBy(order)) + F.col("_base") + start
    return cut.join(F.broadcast(sizes), "_p").withColumn(id_col, F.concat(F.lit(prefix), F.when(n < 10**width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string")))).drop("_p", "_base")


def name_classes(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``(norm, members, first)``: one row per normalised name."""
    return df.select(F.col(id_col).alias("id"), normalize_text(F.coalesce(name_col, F.lit(""))).alias("norm")).where("norm <> ''").groupBy("norm").agg(F.count("*").alias("members"), F.min("id").alias("first"))


def similar_names(classes: DataFrame, threshold: float) -> DataFrame:
    """``(x, y, similarity)`` of all pairs of different names with 1 - distance / longer length >= threshold; x < y.

    Exact, by rare grams: d edits leave all but 2 d of a name's bigrams (its ends count as characters). Two names that
    are near therefore share one of the rarest of each, as many as may be lost and one more. Such names meet at the rarest gram they share, so once, and are compared up to the distance that is allowed.
    Below ``FEW_EDITS`` nearly all pairs would meet, and blocks of names are compared by tries (``similar_classes``).
    """
    if threshold < FEW_EDITS:
        return similar_classes(classes.select("norm", F.lit(1).alias("members")), threshold).select("x", "y", "similarity")
    size = 2
    rows = classes.select("norm", F.length("norm").alias("len")).where("len > 0")
    d = F.floor((1 - F.lit(threshold)) * F.col("len") + 1e-9).cast("int")
    padded = F.concat(F.lit("\u0002"), "norm", F.lit("\u0003"))
    total = F.col("len") + 1
    cut = rows.select("norm", "len", F.posexplode(F.transform(F.sequence(F.lit(1), total), lambda i: F.substring(padded, i, size))).alias("i", "c"))
    # The same gram again is another gram.
    each = cut.select("norm", "len", F.concat("c", F.row_number().over(Window.partitionBy("norm", "c").orderBy("i")).cast("string")).alias("g"))
    often = each.groupBy("g").agg(F.count("*").alias("n"))
    sorted_ = each.join(often, "g").groupBy("norm", "len").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("all"))
    most = F.least(total, size * d + 1)
    pre = sorted_.select("norm", "len", F.slice("all", F.lit(1), most).alias("pre"))
    one = pre.select(F.explode("pre").alias("e"), "norm", "len", F.col("pre.g").alias("pre")).select("e.g", F.ceil(F.col("e.n") / GRAM_BLOCK).cast("int").alias("parts"), "norm", "len", "pre")
    # The names of a frequent gram are cut into blocks that meet all the others. Small in bytes, large in pairs: the
    # number of tasks is set, or they would be put together.
    tasks = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(e: str, part: Column) -> DataFrame:
        return one.select("g", part.alias("part"), F.col("norm").alias(e), F.col("len").alias(f"l{e}"), F.col("pre").alias(f"p{e}")).repartition(tasks, "g", "part")

    x, y = side("x", F.pmod(F.xxhash64("norm"), F.col("parts")).cast("int")), side("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    longer = F.greatest("lx", "ly")
    met = x.join(y, ["g", "part"]).where((F.col("x") < F.col("y")) & (F.least("lx", "ly") >= F.lit(threshold) * longer - 1e-9))
    met = met.where(F.array_intersect("px", "py")[0] == F.col("g"))
    close = met.withColumn("most", F.floor((1 - F.lit(threshold)) * longer + 1e-9).cast("int")).withColumn("d", F.expr("levenshtein(x, y, most)")).where("d >= 0")
    return close.select("x", "y", (1 - F.try_divide("d", longer)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def similar_classes(classes: DataFrame, threshold: float, block: int = NAME_BLOCK) -> DataFrame:
    """``(x, y, similarity, members_x, members_y)``, the pairs of ``similar_names`` with the members of both names.

    The names are written once to the shared folder in blocks, sorted from their ends. Each pair of blocks is a row of
    its own: its task reads both and gives the near pairs (``near``), so what is written is the names and never a pair.
    """
    spark = classes.sparkSession
    if threshold >= FEW_EDITS:
        m = classes.select("norm", "members")
        pairs = similar_names(classes, threshold)
        return pairs.join(m.select(F.col("norm").alias("x"), F.col("members").alias("members_x")), "x").join(m.select(F.col("norm").alias("y"), F.col("members").alias("members_y")), "y")
    ship_path(spark)
    rows = cut_lineage(classes.where(F.length("norm") > 0).select("norm", F.col("members").cast("long").alias("members")))
    total, letters = rows.agg(F.count("*"), F.sum(F.length("norm"))).first()
    block = min(block, max(512, -(-total // 8)))
    folder = work_folder(spark, "names")
    end = F.reverse("norm")
    rows.repartitionByRange(max(1, -(-total // block), (letters or 0) // (64 * block)), end).sortWithinPartitions(end).write.parquet(folder)
    files = sorted(spark.read.schema("norm string, members long").parquet(folder).inputFiles())
    n = len(files)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(path: str) -> pa.Table:
            where, path = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
            return pq.read_table(path, filesystem=where).combine_chunks()

        def rows(i: int, j: int, a: pa.Table, b: pa.Table, found: list) -> pa.RecordBatch:
            p, s, d, longer = (np.concatenate(c) for c in zip(*found))
            similarity = 1 - d / longer
            ok = similarity >= threshold - 1e-12
            if i == j:
                ok &= p < s
            p, s = pa.array(p[ok]), pa.array(s[ok])
            x, y, mx, my = a["norm"].take(p).combine_chunks(), b["norm"].take(s).combine_chunks(), a["members"].take(p).combine_chunks(), b["members"].take(s).combine_chunks()
            less = pc.less(x, y)
            pick = lambda u, v: pc.if_else(less, u, v)
            return pa.RecordBatch.from_arrays([pick(x, y), pick(y, x), pa.array(similarity[ok]), pick(mx, my), pick(my, mx)], ["x", "y", "similarity", "members_x", "members_y"])

        for batch in batches:
            for at in batch.column("id").to_pylist():
                # Every unordered pair of blocks once: a block and the one so many places on, around the end.
                i = at % n
                j = (i + at // n) % n
                a, b = read(files[i]), read(files[j])
                codes: dict[str, int] = {}
                patterns, strings = near.runs(a["norm"].to_pylist(), codes), near.runs(b["norm"].to_pylist(), codes)
                found, held = [], 0
                for s in strings:
                    levels = near.trie(s, threshold)
                    for p in patterns:
                        for u, v, d in near.near(p, levels, len(codes), threshold):
                            found.append((p.index[u], s.index[v], d, np.maximum(p.length[u], s.length[v])))
                            held += len(u)
                            if held >= 1 << 15:
                                yield rows(i, j, a, b, found)
                                found, held = [], 0
                if found:
                    yield rows(i, j, a, b, found)

    pairs = n * (n + 1) // 2
    return spark.range(0, pairs, 1, max(1, min(pairs, 10_000))).mapInArrow(work, "x string, y string, similarity double, members_x long, members_y long")


def _scored_fields(concepts: DataFrame) -> DataFrame:
    """``(id, n1, n2, definition, concept_type, country_tag, four_axis)`` as the score sees them, of records with a name."""
    definition = F.coalesce("definition", F.lit(""))
    axes = F.array_sort(F.array_distinct(F.coalesce("four_axis", F.array().cast("array<string>"))))
    return concepts.select(
        "id", normalize_text(F.coalesce("en_name", F.lit(""))).alias("n1"), normalize_text(F.coalesce("jp_name", F.lit(""))).alias("n2"),
        F.when(definition != "", normalize_text(definition)).alias("definition"), "concept_type", "country_tag", axes.alias("four_axis"),
    ).where("n1 <> '' OR n2 <> ''")


def record_classes(concepts: DataFrame) -> DataFrame:
    """Records that no part of the score can tell apart as one row: all fields of the score, smallest id, members."""
    return _scored_fields(concepts).groupBy("n1", "n2", "definition", "concept_type", "country_tag", "four_axis").agg(F.min("id").alias("id"), F.count("*").alias("members"))


def class_members(concepts: DataFrame) -> DataFrame:
    """``(id, class_id)``: the class of every record with a name, by the smallest id of the class."""
    same = Window.partitionBy("n1", "n2", "definition", "concept_type", "country_tag", "four_axis")
    return _scored_fields(concepts).select("id", F.min("id").over(same).alias("class_id"))


def name_representatives(concepts: DataFrame) -> DataFrame:
    """The record of the smallest id of each name alone, with the number of records of the name."""
    fields = F.struct("definition", "concept_type", "country_tag", "four_axis")
    return _scored_fields(concepts).groupBy("n1", "n2").agg(F.min("id").alias("id"), F.count("*").alias("members"), F.min_by(fields, "id").alias("f")).select("n1", "n2", "f.*", "id", "members")


def duplicate_candidates(concepts: DataFrame, threshold: float = 0.6, name_least: float = 0.4) -> DataFrame:
    """Pairs of records that may be one: ``0.5 name + 0.3 definition + 0.2 structure`` of at least ``threshold``.

    ``concepts``: id (unique), en_name, jp_name, definition, concept_type, country_tag, four_axis. The name similarity
    is the better one of the two names and must reach ``name_least``. Records equal in all of these are one class
    (``class_members`` has its records), so a pair of classes stands for every pair of their records; a class of two or
    more members is also paired with itself.
    """
    return score_classes(record_classes(concepts), threshold, name_least)


def score_classes(classes: DataFrame, threshold: float, name_least: float) -> DataFrame:
    """Pairs of classes, as ``duplicate_candidates``. Near names are found once for each name, then met by its classes."""
    named = classes.select("n1", "n2").distinct().withColumn("key", F.struct("n1", "n2"))
    pairs = None
    for n in ("n1", "n2"):
        names = named.where(F.col(n) != "").select(F.col(n).alias("norm"), "key")
        close = similar_names(names.select("norm").distinct(), name_least)
        equal = names.select(F.col("norm").alias("x"), F.col("norm").alias("y"), F.lit(1.0).alias("similarity")).distinct()
        both = close.unionByName(equal)
        one = both.join(names.select(F.col("norm").alias("x"), F.col("key").alias("i")), "x").join(names.select(F.col("norm").alias("y"), F.col("key").alias("j")), "y")
        one = one.select(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "similarity")
        pairs = one if pairs is None else pairs.unionByName(one)
    best = pairs.groupBy("p", "q").agg(F.max("similarity").alias("name_similarity"))
    rows = classes.select(F.struct("n1", "n2").alias("key"), F.struct("id", "members", "definition", "concept_type", "country_tag", "four_axis").alias("f"))
    met = best.join(rows.select(F.col("key").alias("p"), F.col("f").alias("a")), "p").join(rows.select(F.col("key").alias("q"), F.col("f").alias("b")), "q")
    met = met.where((F.col("p") < F.col("q")) | (F.col("a.id") < F.col("b.id")) | (F.col("a").eqNullSafe(F.col("b")) & (F.col("a.members") > 1)))
    x, y = F.col("a.definition"), F.col("b.definition")
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    d = F.when(x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(1 - F.try_divide(F.levenshtein(x, y), long))
    most = F.when(x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(F.try_divide(short, long))  # the lengths alone bound it
    s = structural_similarity(F.col("a.concept_type"), F.col("b.concept_type"), F.col("a.country_tag"), F.col("b.country_tag"), F.col("a.four_axis"), F.col("b.four_axis"))
    score = lambda d: 0.5 * F.col("name_similarity") + 0.3 * d + 0.2 * s
    met = met.where(score(most) >= threshold - 1e-9).where(score(d) >= threshold)
    end = lambda e: F.struct(F.col(f"{e}.id").alias("id"), F.col(f"{e}.members").alias("members"))
    out = met.select(F.least(end("a"), end("b")).alias("u"), F.greatest(end("a"), end("b")).alias("v"), "name_similarity", d.alias("definition_similarity"), s.alias("structural_similarity"), score(d).alias("overall"))
    tier = similarity_tier(F.col("overall"), 0.9, 0.8, threshold)
    return out.select(F.col("u.id").alias("id_a"), F.col("v.id").alias("id_b"), F.col("u.members").alias("members_a"), F.col("v.members").alias("members_b"), "name_similarity", "definition_similarity", "structural_similarity", "overall", tier.alias("confidence"), tier_action(tier).alias("action"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine_search(vectors: DataFrame, queries: DataFrame, threshold: float, upper: float | None = None) -> DataFrame:
    """``(query, id, similarity)`` of every query against all vectors, in blocks; a query is not its own match.

    Queries are broadcast as one matrix while they are few (``BROADCAST_ROWS``, checked); more are cut into blocks,
    each row meeting one block after another.
    """
    spark = vectors.sparkSession
    total = queries.count()
    top = float("inf") if upper is None else upper
    blocks = max(1, -(-total // BROADCAST_ROWS))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        t = part.select("id", "vec").toArrow()
        names = t["id"].to_pylist()
        mat = _matrix(t["vec"]) if names else np.zeros((0, 1))
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((names, mat))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, mat = shared.value
            labels = pa.array(names)
            for batch in batches:
                if not len(names) or not batch.num_rows:
                    continue
                x = _matrix(batch.column("vec"))
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                for i in range(0, len(x), 1024):
                    s = x[i : i + 1024] @ mat.T
                    r, c = np.nonzero((s >= threshold) & (s < top))
                    ids = batch.column("id").take(pa.array(r + i))
                    yield pa.RecordBatch.from_arrays([labels.take(pa.array(c)), ids, pa.array(s[r, c])], ["query", "id", "similarity"])

        kind = dict(vectors.dtypes)["id"]
        one = vectors.select("id", "vec").mapInArrow(work, f"query {kind}, id {kind}, similarity double").where("query <> id")
        out = one if out is None else out.unionByName(one)
    return out


CELLS = 1024
CELL_BLOCK = 4096


def cosine_pairs(vectors: DataFrame, threshold: float, upper: float | None = None, cells: int | None = None, block: int = CELL_BLOCK) -> DataFrame:
    """``(id_a, id_b, similarity)``: all pairs of different ids, the smaller first, with a cosine of at least ``threshold``.

    Complete, by cells: a vector lies in the cell of its nearest pivot (a vector chosen by hash) and meets only cells
    whose radius leaves room for the angle of the threshold, for angles obey the triangle inequality. Of two cells the
    smaller visits the larger, so a pair is met once. Cells and visitors are cut into blocks; each pair of blocks is a
    task of its own. How much is left out depends on the data and the threshold; nothing of the answer is.

    Vectors that are null, empty or zero take no part; all others must have one length. An id has one vector.
    """
    spark = vectors.sparkSession
    v = F.col("vec")
    rows = vectors.select("id", v.cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    kind = dict(rows.dtypes)["id"]
    total = rows.count()
    k = cells or int(max(1, min(CELLS, total**0.5)))
    picked = rows.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(k).select("vec").toArrow()["vec"]
    if not len(picked):
        return spark.createDataFrame([], f"id_a {kind}, id_b {kind}, similarity double")
    pivots = _matrix(picked)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    angle, top = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6, float("inf") if upper is None else upper

    def angles(batch: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
        x = _matrix(batch.column("vec"))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return np.arccos(np.clip(x @ pivots.T, -1, 1))

    pivot = spark.sparkContext.broadcast(pivots)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = angles(batch, pivot.value)
                home = a.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(a[np.arange(len(a)), home])], ["cell", "angle"])

    found = rows.select("vec").mapInArrow(homes, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # one row a cell
    radius, load = np.full(len(pivots), -9.0), np.zeros(len(pivots))
    for r in found:
        radius[r.cell], load[r.cell] = r.r, r.n
    known = spark.sparkContext.broadcast((pivots, radius))

    def visits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pivots, radius = known.value
        a = angles(batch, pivots)
        home = a.argmin(1)
        r, c = np.nonzero((a <= radius + angle) & (np.arange(len(pivots)) > home[:, None]))
        at = np.arange(len(a))
        return np.concatenate([at, r]), np.concatenate([home, c]), np.concatenate([np.ones(len(a), bool), np.zeros(len(r), bool)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, n = np.unique(visits(batch)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(n, pa.int64())], ["cell", "n"])

    asks = np.zeros(len(pivots))
    for r in rows.select("vec").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        asks[r.cell] = r.n
    parts = spark.sparkContext.broadcast([np.maximum(1, -(-x // block)).astype(np.int64) for x in (load, asks)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, queries = parts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            salt = batch.column("salt").to_numpy(zero_copy_only=False)
            r, c, own = visits(batch)
            out = []
            # A query goes to every block of the cell, a vector of the cell to every part of the queries.
            for at, many, mine, role in ((np.arange(len(r)), blocks, queries, np.where(own, 1, 0)), (np.flatnonzero(own), queries, blocks, np.full(len(r), 2))):
                n = many[c[at]]
                at = np.repeat(at, n)
                j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                m = (salt[r[at]] >> (20 if many is queries else 0)) % mine[c[at]]
                b, q = (m, j) if many is queries else (j, m)
                out.append((r[at], c[at], b, q, role[at]))
            r, c, b, q, role = (np.concatenate(x) for x in zip(*out))
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(b, pa.int32()), pa.array(q, pa.int32()), pa.array(role, pa.int32()), batch.column("id").take(take), batch.column("vec").take(take)], ["cell", "block", "part", "role", "id", "vec"])

    def meet(key, group):
        group = group.combine_chunks()
        role = group["role"].to_numpy()
        x = _matrix(group["vec"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = group["id"].to_pylist()
        q, m = np.flatnonzero(role < 2), np.flatnonzero(role == 2)
        a, b, s = [], [], []
        for i in range(0, len(q), 1024):
            sim = x[q[i : i + 1024]] @ x[m].T
            for r, c in zip(*np.nonzero((sim >= threshold) & (sim < top))):
                u, v = q[i + r], m[c]
                if role[u] == 0 or ids[u] < ids[v]:
                    a.append(min(ids[u], ids[v]))
                    b.append(max(ids[u], ids[v]))
                    s.append(sim[r, c])
        return pa.table([pa.array(a, group["id"].type), pa.array(b, group["id"].type), pa.array(s, pa.float64())], ["id_a", "id_b", "similarity"])

    placed = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).mapInArrow(place, f"cell int, block int, part int, role int, id {kind}, vec array<float>")
    return placed.groupBy("cell", "block", "part").applyInArrow(meet, f"id_a {kind}, id_b {kind}, similarity double")


def embed(concepts: DataFrame, id_col: str = "concept_id", dim: int = 64, gram: int = 3) -> DataFrame:
    """``(id, vec)``: a vector of each concept's ``jp_name en_name definition``, or of ``unknown`` if all are empty.

    Counts of character n-grams, hashed into ``dim`` places by a polynomial of their code points, so the vectors need no
    model and are the same everywhere. Any other source of vectors with these two columns does as well.
    """
    rows = concepts.select(F.col(id_col).alias("id"), strip(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("jp_name", "en_name", "definition")])).alias("t"))
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), np.float32)
            for i, t in enumerate(batch.column("t").to_pylist()):
                p = np.frombuffer((t or "unknown").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                g = min(gram, len(p))
                h = np.zeros(len(p) - g + 1, np.int64)
                for j in range(g):
                    h = h * 31 + p[j : j + len(h)]
                out[i] = np.bincount(h % dim, minlength=dim)
            flat = pa.array(out.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), flat)], ["id", "vec"])

    return rows.mapInArrow(work, f"id {kind}, vec array<float>")


def tiers(pairs: DataFrame, high: float, medium: float, low: float, low_most: int = 50) -> DataFrame:
    """Pairs of the high and medium tier, and the ``low_most`` best of the low one, with confidence and action."""
    tier = similarity_tier(F.col("similarity"), high, medium, low)
    sure = pairs.where(F.col("similarity") >= medium)
    rest = pairs.where((F.col("similarity") >= low) & (F.col("similarity") < medium)).orderBy(F.col("similarity").desc(), "id_a", "id_b").limit(low_most)
    return sure.unionByName(rest).withColumn("confidence", tier).withColumn("action", tier_action(tier))


def duplicate_report(candidates: DataFrame, concepts: DataFrame, method: str, threshold: float) -> DataFrame:
    """One row: concepts, candidates, those of each tier, method and threshold."""
    n = concepts.agg(F.count("*").alias("total_concepts"))
    c = candidates.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("confidence") == t).alias(t) for t in ("high", "medium", "low")])
    return n.crossJoin(c).withColumn("method", F.lit(method)).withColumn("threshold", F.lit(threshold))  # one row each
