"""Streams: the orphan state maintained from micro-batches, and windowed counts with late data.

The batch operators are reused: a micro-batch becomes deltas against the state before it, and deltas add up. The state
is a table with one row per key, written as a new version for every batch, and the references are a log of what each
batch brought; a batch that is retried after a failure reads what was before it and gives the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import orphans


def orphan_state_writer(base: str, references: Callable[[DataFrame], DataFrame] | None = None, records: Callable[[DataFrame], DataFrame] | None = None):
    """A ``foreachBatch`` function that brings the state under ``base`` up to date.

    ``references`` makes references of a batch (as ``orphans.references``), ``records`` makes ``(key, loaded, deleted)``;
    either may be left out. Batch n reads what lies before it and writes or overwrites its own version only.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = _read(spark, f"{base}/state", n, last=True)
        parts = [] if state is None else [state]
        if references is not None:
            refs, known = references(batch), _read(spark, f"{base}/refs", n)
            refs = orphans.news(refs, known) if known is not None else refs.withColumn("seen", F.lit(False))
            refs.write.mode("overwrite").parquet(f"{base}/refs/batch={n}")
            parts.append(orphans.reference_deltas(spark.read.parquet(f"{base}/refs/batch={n}")))
        if records is not None:
            parts.append(orphans.existence(records(batch), "key", "loaded", "deleted", state))
        orphans.apply_deltas(*parts).write.mode("overwrite").parquet(f"{base}/state/batch={n}")

    return write


def _batches(spark: SparkSession, base: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/batch=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found or ())


def _read(spark: SparkSession, base: str, before: int, last: bool = False) -> DataFrame | None:
    """What the batches before one wrote, or the last of them did."""
    found = [n for n in _batches(spark, base) if n < before]
    return spark.read.parquet(*[f"{base}/batch={n}" for n in (found[-1:] if last else found)]) if found else None


def latest_state(spark: SparkSession, base: str) -> DataFrame:
    """The state after the last batch, on whatever file system it lies."""
    return _read(spark, f"{base}/state", 1 << 62, last=True)


def known_references(spark: SparkSession, base: str) -> DataFrame:
    """Every reference of all batches once, at its earliest time."""
    return orphans.earliest(_read(spark, f"{base}/refs", 1 << 62))


def windowed_counts(events: DataFrame, time: str, key: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; rows later than the watermark are left out. For streams and tables alike."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", late)
    w = F.window("_t", length, slide) if slide else F.window("_t", length)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
