"""Readers of the project's files, with explicit schemas."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions.text import sanitize_source_id, stem, strip
from weftline.session import cut_lineage


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob, has any file, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found is not None and len(found))


def require_tool(name: str) -> str:
    """Path of an external program, or an error that says what is missing."""
    path = shutil.which(name)
    if path is None:
        raise FileNotFoundError(f"{name} is not installed")
    return path


def read_texts(spark: SparkSession, directory: str) -> DataFrame:
    """``(source_id, source_file, text)``, one row per .txt file; bytes that are no UTF-8 are dropped."""
    raw = spark.read.text(f"{directory}/*.txt", wholetext=True)
    text = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return raw.select(sanitize_source_id(stem(name)).alias("source_id"), name.alias("source_file"), text.alias("text"))


def extract_texts(spark: SparkSession, directory: str, pattern: str = "*.pdf", command: Sequence[str] = ("pdftotext", "-layout", "{}", "-")) -> tuple[DataFrame, DataFrame]:
    """``(source_id, source_file, text)`` by an external program, and the files it fails on ``(source_file, reason)``.

    Documents are read by Spark from any file system and given to the program one at a time, as a file in the place of
    ``{}``; what it prints is the text. An empty file is no document. It must be there on every machine; the driver checks its own.
    """
    require_tool(command[0])
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select(F.url_decode(F.replace(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("+"), F.lit("%2B"))).alias("source_file"), "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, reasons = [], []
            for content in batch.column("content").to_pylist():
                with tempfile.NamedTemporaryFile() as f:
                    f.write(content)
                    f.flush()
                    try:
                        done = subprocess.run([f.name if a == "{}" else a for a in command], capture_output=True, timeout=600)
                        ok, reason = done.returncode == 0, done.stderr.decode("utf-8", "replace")[:200]
                    except (OSError, subprocess.TimeoutExpired) as e:
                        ok, reason = False, str(e)[:200]
                texts.append(done.stdout.decode("utf-8", "ignore") if ok else None)
                reasons.append(None if ok else reason)
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), pa.array(texts, pa.string()), pa.array(reasons, pa.string())], ["source_file", "text", "reason"])

    done = cut_lineage(raw.mapInArrow(work, "source_file string, text string, reason string"))  # each document is read once
    good = done.where("text IS NOT NULL").select(sanitize_source_id(stem("source_file")).alias("source_id"), "source_file", "text")
    return good, done.where("text IS NULL").select("source_file", "reason")


def read_html(spark: SparkSession, directory: str, pattern: str = "*.html") -> DataFrame:
    """``(source_id, source_file, text)`` of HTML files: scripts, styles and tags removed, in the JVM."""
    raw = spark.read.text(f"{directory}/{pattern}", wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    body = F.regexp_replace(F.make_valid_utf8("value"), r"(?is)<(script|style)\b.*?</\1>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n"), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return raw.select(sanitize_source_id(stem(name)).alias("source_id"), name.alias("source_file"), strip(body).alias("text"))


def read_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNK).json(f"{directory}/*/chunk_*.json", multiLine=True)


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as ``write_chunks`` leaves them, one folder to a source."""
    return spark.read.schema(schemas.CHUNK).json(path)


def read_newest(spark: SparkSession, base: str) -> DataFrame:
    """The newest version that ``write_version`` wrote under a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/version=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise FileNotFoundError(base)
    return spark.read.parquet(max(f.getPath().toString() for f in found))


def read_stored_document(spark: SparkSession, path: str, list_name: str, schema: str, metadata: str) -> tuple[DataFrame, DataFrame]:
    """Rows and metadata that ``write_document`` wrote."""
    return spark.read.schema(schema).json(f"{path}/{list_name}"), spark.read.schema(metadata).json(f"{path}/metadata")


def _with_folder(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    df = spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(pattern, multiLine=True)
    return df.withColumn("path", F.col("_metadata.file_path")).withColumn("folder", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1))


def read_concept_files(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Concepts of all extraction files, and the files that can't be read ``(path, source_id, reason)``.

    In a folder with a ``concepts.json`` only that file counts.
    """
    files = _with_folder(spark, f"{directory}/*/*.json", schemas.EXTRACTION)
    merged = (F.col("file") == "concepts.json").cast("int")
    chosen = files.withColumn("_m", merged).withColumn("_any", F.max("_m").over(Window.partitionBy("folder"))).where("_m = _any")
    bad = chosen.where(F.col("_corrupt").isNotNull()).select("path", "source_id", F.lit("malformed").alias("reason"))
    good = chosen.where(F.col("_corrupt").isNull()).select(F.coalesce("source_id", "folder").alias("source_id"), "path", F.inline("concepts"))
    return good, bad


def read_extractions(spark: SparkSession, directory: str) -> DataFrame:
    """``(ord, jp, en, sources)``: sources of every pair of names over all files, in the order of the files."""
    files = _with_folder(spark, f"{directory}/*/*.json", schemas.EXTRACTION).where(F.col("_corrupt").isNull())
    rows = files.select(F.coalesce("source_id", "folder").alias("source_id"), "path", F.posexplode("concepts").alias("pos", "c"))
    jp, en = strip(F.coalesce("c.jp_name", F.lit(""))), F.lower(strip(F.coalesce("c.en_name", F.lit(""))))
    return rows.groupBy(jp.alias("jp"), en.alias("en")).agg(F.min(F.struct("path", "pos")).alias("ord"), F.array_sort(F.collect_set("source_id")).alias("sources"))


def read_concept_db(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and relationships of a concept database; empty tables if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CONCEPT), spark.createDataFrame([], schemas.RELATIONSHIP)
    db = spark.read.schema(schemas.CONCEPT_DB).json(path, multiLine=True)
    return db.select(F.inline("concepts")), db.select(F.inline("relationships"))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of a known schema; it must be there and whole."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_document(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_manual_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(category, source, target, type)`` of the two-level file of manual relations."""
    rows = read_document(spark, path, schemas.MANUAL).select(F.inline("relationships"))
    return rows.select("category", F.inline("edges"))


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    rows = read_optional(spark, path, schemas.INFERRED).select(F.inline("relationships"))
    return rows.select("source", "target", F.coalesce("type", F.lit("subsumption")).alias("type"), F.col("similarity.heuristic_confidence").alias("confidence"), "reasoning")


def literal_papers(spark: SparkSession, papers: list[dict]) -> DataFrame:
    """``(source, domain, concept, type, context)`` from records with nested concepts."""
    rows = [(p["source"], p["domain"], c["concept"], c["type"], c.get("context")) for p in papers for c in p["concepts"]]
    return spark.createDataFrame(rows, "source string, domain string, concept string, type string, context string")
