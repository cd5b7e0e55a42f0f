"""Compare a registered query with its SQL: order-insensitive, columns sorted by name."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings concept concept_vec edges gaps merge_candidates chunk provenance_trust mix_target size_limit".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql: str, d: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(d, f"{t}.parquet")
        if os.path.exists(p):
            src = f"{p}/*.parquet" if os.path.isdir(p) and glob.glob(f"{p}/*.parquet") else p
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{src}')")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())


def compare(df, sql: str, d: str) -> str:
    """'' if equal, else what differs."""
    (c1, a), (c2, b) = spark_rows(df), duck_rows(sql, d)
    if c1 != c2:
        return f"columns {c1} and {c2}"
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    return ""
