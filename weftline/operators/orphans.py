"""References to records that do not exist.

References and existence are kept as signed counts per key.  A *delta* is one row
``(key, refs, exists, loads, first_loaded, first_ref)``; adding deltas up gives the *state*, and two states of
different inputs add up to a state.  A day's changes are turned into deltas against the state before them, so that
history isn't read again: +1 at the first load of a key, -1 at its deletion, nothing for a delivery that says nothing
new (``existence``); +1 for a reference that is not known yet (``reference_deltas`` with ``known``), -1 for one that
is taken away.  Whatever way the deliveries are split into batches, and in whatever order these come, the state is
that of all of them at once.

A key with positive references and no existence is an orphan: ``missing`` if it was never loaded, ``deleted``
otherwise.  A key that exists but was first loaded after some reference to it is a candidate for ``late``.

Edge cases: null and blank ids refer to nothing and give no delta; empty tables give an empty report; repeated
deliveries count once, at their earliest time; a reference whose time is unknown is never late; extra columns
are ignored since every input is projected first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import canonical_id

STATE = ("key", "refs", "exists", "loads", "first_loaded", "first_ref")


@dataclass(frozen=True)
class ReferenceSet:
    """Where references come from: ``refs`` maps a field name to its column; arrays are exploded."""

    table: str
    rows: DataFrame
    owner: str
    time: str
    refs: tuple[str, ...]
    array: bool = False


def references(source: ReferenceSet) -> DataFrame:
    """``(ref_table, owner_id, field, ref_id, ref_time)``: one row per reference, at its earliest delivery."""
    ids = [
        F.array_distinct(F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), canonical_id)) if source.array else canonical_id(f)
        for f in source.refs
    ]
    once = (
        source.rows.select(canonical_id(source.owner).alias("owner_id"), *[c.alias(f"r{i}") for i, c in enumerate(ids)], F.col(source.time).alias("t"))
        .groupBy("owner_id", *[f"r{i}" for i in range(len(ids))])
        .agg(F.min("t").alias("ref_time"))
    )
    parts = [
        F.struct(F.lit(f).alias("field"), (F.col(f"r{i}") if source.array else F.array(F.col(f"r{i}"))).alias("ids"))
        for i, f in enumerate(source.refs)
    ]
    return (
        once.select("owner_id", "ref_time", F.inline(F.array(*parts)))
        .select("owner_id", "ref_time", "field", F.explode("ids").alias("ref_id"))
        .where(F.col("ref_id").isNotNull())
        .select(F.lit(source.table).alias("ref_table"), "owner_id", "field", "ref_id", "ref_time")
    )


def existence(rows: DataFrame, key: str, loaded: str, deleted: str, state: DataFrame | None = None) -> DataFrame:
    """Existence deltas of a batch of records against the state before it.

    +1 for a key not loaded before, -1 for one that is deleted and wasn't; a key that is new and deleted at once gives
    one load and no existence. A deleted key stays so when it is delivered again.
    """
    once = (
        rows.select(canonical_id(key).alias("key"), F.col(loaded).cast("timestamp_ntz").alias("l"), F.col(deleted).isNotNull().cast("long").alias("d"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("l").alias("first_loaded"), F.max("d").alias("gone"))
    )
    was, had = F.lit(0).cast("long"), F.lit(0).cast("long")
    if state is not None:
        once = once.join(state.select("key", F.col("exists").alias("_e"), F.col("loads").alias("_l")), "key", "left")
        was, had = F.coalesce("_e", F.lit(0).cast("long")), F.coalesce("_l", F.lit(0).cast("long"))
    now = F.when((had > 0) & (was <= 0), 0).otherwise(1 - F.col("gone")).cast("long")
    return once.select(
        "key", F.lit(0).cast("long").alias("refs"), (now - was).alias("exists"), F.when(had > 0, 0).otherwise(1).cast("long").alias("loads"),
        "first_loaded", F.lit(None).cast("timestamp_ntz").alias("first_ref"),
    )


REFERENCE = ("ref_table", "owner_id", "field", "ref_id")


def news(refs: DataFrame, known: DataFrame) -> DataFrame:
    """The references that ``known`` has not, or has at a later time only; ``seen`` says which. An owner id names one row."""
    before = known.groupBy(*REFERENCE).agg(F.min("ref_time").alias("_t"), F.lit(True).alias("_k"))
    cond = [refs[c].eqNullSafe(before[c]) for c in REFERENCE]
    both = refs.join(before, cond, "left").select(*[refs[c] for c in refs.columns], "_t", F.coalesce("_k", F.lit(False)).alias("seen"))
    return both.where(~F.col("seen") | (F.col("ref_time") < F.col("_t")) | (F.col("_t").isNull() & F.col("ref_time").isNotNull())).drop("_t")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Reference deltas; ``sign=-1`` takes references away (their owner was changed).

    Of references against those known before (``news``) the ones seen only bring their earlier time.
    """
    count = F.when(F.col("seen"), 0).otherwise(sign) if "seen" in refs.columns else F.lit(sign)
    return refs.select(
        F.col("ref_id").alias("key"), count.cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"),
        F.lit(0).cast("long").alias("loads"), F.lit(None).cast("timestamp_ntz").alias("first_loaded"), F.col("ref_time").cast("timestamp_ntz").alias("first_ref"),
    )


def earliest(*parts: DataFrame) -> DataFrame:
    """Each reference once, at its earliest time, from what the batches brought."""
    rows = parts[0].select(*REFERENCE, "ref_time")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*REFERENCE, "ref_time"))
    return rows.groupBy(*REFERENCE).agg(F.min("ref_time").alias("ref_time"))


def apply_deltas(*parts: DataFrame) -> DataFrame:
    """The state after adding up states and deltas; map-side sums, so a hot key is one row per task."""
    rows = parts[0].select(*STATE)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*STATE))
    return rows.groupBy("key").agg(
        F.sum("refs").alias("refs"), F.sum("exists").alias("exists"), F.sum("loads").alias("loads"),
        F.min("first_loaded").alias("first_loaded"), F.min("first_ref").alias("first_ref"),
    )


def suspects(state: DataFrame) -> DataFrame:
    """Keys of the state to which at least one reference is, or may be, an orphan."""
    return state.where((F.col("refs") > 0) & ((F.col("exists") <= 0) | (F.col("first_loaded") > F.col("first_ref"))))


def orphan_status() -> Column:
    return (
        F.when(F.col("loads") <= 0, "missing").when(F.col("exists") <= 0, "deleted")
        .when(F.col("first_loaded") > F.col("ref_time").cast("timestamp_ntz"), "late")
    )


def orphan_report(refs: DataFrame, state: DataFrame) -> DataFrame:
    """Each orphan reference with table, month, owner and status.

    Only suspect keys are joined; they are unique, so the join never multiplies rows, and a popular orphan key is
    split by the adaptive skew join since nothing after the join needs its partitioning.
    """
    bad = suspects(state).select(F.col("key").alias("ref_id"), "exists", "loads", "first_loaded")
    return (
        refs.join(bad, "ref_id")
        .withColumn("status", orphan_status())
        .where(F.col("status").isNotNull())
        .select("ref_table", F.date_format("ref_time", "yyyy-MM").alias("period"), "owner_id", "field", "ref_id", "status")
    )


def orphan_counts(report: DataFrame) -> DataFrame:
    """Orphans per table, month and status."""
    return report.groupBy("ref_table", "period", "field", "status").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("keys"))
