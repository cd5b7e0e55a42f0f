"""Sinks. A path that is being read is never overwritten: tables are written as new versions."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_ROWS = 5_000


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines partitioned by source; what an earlier run left is replaced."""
    chunks.write.mode("overwrite").partitionBy("source_id").json(path)


def write_version(df: DataFrame, base: str, version: str) -> str:
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, characters kept as they are."""
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str, list_name: str, **metadata: str) -> None:
    """Rows as JSON lines beside a one-row table of metadata and the count."""
    df.write.mode("overwrite").json(f"{path}/{list_name}")
    meta = df.agg(F.count("*").alias("count"))
    for k, v in metadata.items():
        meta = meta.withColumn(k, F.lit(v))
    meta.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_failures(bad: DataFrame, path: str) -> None:
    bad.write.mode("append").json(path)


def export_html(template: str, out: str, title: str | None = None, **documents: DataFrame | dict[str, DataFrame]) -> None:
    """A standalone page: what it fetches as ``<name>.json`` comes out of the page, and its title says so.

    A document is a list of rows, or an object of several. The data go into a script before ``</head>`` that answers
    the page's own ``fetch`` calls for these names, so the page's code stays as it is; ``window.DATA`` has them as well.
    A page is for people to look at: more than ``PAGE_ROWS`` rows of a table are refused.
    """

    def rows(name: str, df: DataFrame) -> list:
        found = df.toJSON().take(PAGE_ROWS + 1)
        if len(found) > PAGE_ROWS:
            raise ValueError(f"{name}: more than {PAGE_ROWS} rows for one page")
        return [json.loads(r) for r in found]

    data = {n: {k: rows(f"{n}.{k}", x) for k, x in v.items()} if isinstance(v, dict) else rows(n, v) for n, v in documents.items()}
    with open(template, encoding="utf-8") as f:
        page = f.read()
    script = (
        f"<script>window.DATA = {json.dumps(data, ensure_ascii=False).replace('</', '<' + chr(92) + '/')};\n"
        "(() => { const net = window.fetch; window.fetch = (url, ...rest) => {\n"
        "  const name = String(url).split('/').pop().replace(/\\.json.*$/, '');\n"
        "  return name in window.DATA ? Promise.resolve(new Response(JSON.stringify(window.DATA[name]))) : net(url, ...rest);\n"
        "}; })();</script>\n"
    )
    page = re.sub(r"<title>(.*?)</title>", lambda m: f"<title>{title or m[1] + ' (Standalone)'}</title>", page, flags=re.S)
    page = re.sub(r"(?s)/\* data:begin \*/.*?/\* data:end \*/", "const data = window.DATA;", page)
    page = page.replace("</head>", script + "</head>", 1)
    os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    with open(out, "w", encoding="utf-8") as f:
        f.write(page)
