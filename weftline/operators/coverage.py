"""Coverage of sources by chunks and concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_DENSITY = 0.1
LOW_CHUNKS = 5


def density(concepts: Column, chunks: Column) -> Column:
    return F.coalesce(F.try_divide(concepts.cast("double"), chunks), F.lit(0.0))


def status(concepts: Column, chunks: Column) -> Column:
    return F.when((chunks > 0) & (concepts == 0), "NOT_PROCESSED").when((density(concepts, chunks) < LOW_DENSITY) & (chunks > LOW_CHUNKS), "LOW_DENSITY").when(concepts > 0, "OK").otherwise("UNKNOWN")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.countDistinct("chunk_index").alias("chunks"), F.sum("char_count").alias("chars"))


def concepts_per_source(concepts: DataFrame) -> DataFrame:
    """Concepts by source: every entry of ``source_papers`` and the scalar ``source_paper``."""
    all_ = F.concat(F.coalesce("source_papers", F.array().cast("array<string>")), F.array("source_paper"))
    return concepts.select(F.explode(all_).alias("source_id")).where("source_id IS NOT NULL AND trim(source_id) <> ''").groupBy("source_id").agg(F.count("*").alias("concepts"))


def coverage(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per source with chunks: chunks, concepts, density and status."""
    c = chunk_counts(chunks).join(concepts_per_source(concepts), "source_id", "left").withColumn("concepts", F.coalesce("concepts", F.lit(0)))
    return c.select("source_id", "chunks", "concepts", F.round(density(F.col("concepts"), F.col("chunks")), 3).alias("density"), status(F.col("concepts"), F.col("chunks")).alias("status"))


def coverage_summary(per_source: DataFrame) -> DataFrame:
    n = F.count("*")
    return per_source.agg(
        n.alias("sources"), F.count_if(F.col("concepts") > 0).alias("processed"), F.sum("chunks").alias("chunks"), F.sum("concepts").alias("concepts"),
        F.round(F.coalesce(F.try_divide(F.sum("concepts").cast("double"), F.sum("chunks")), F.lit(0.0)), 3).alias("average_density"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("concepts") > 0) * F.lit(100.0), n), F.lit(0.0)), 1).alias("processed_percent"),
        F.count_if(F.col("status") == "LOW_DENSITY").alias("low_density"), F.count_if(F.col("status") == "NOT_PROCESSED").alias("not_processed"),
    )


def shares(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """Count and percentage of every value."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.groupBy(F.coalesce(column, F.lit(default)).alias(column)).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.try_divide(F.col("n") * 100.0, "total"), 1).alias("percent"))  # one row
