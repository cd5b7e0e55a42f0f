"""Identifiers and enumerated values in canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround an id: blanks, tabs, line ends, no-break and ideographic spaces.
OUTER_SPACE = " \t\r\n 　"


def canonical_id(c: Column | str) -> Column:
    """Upper case without outer white space; a blank id becomes null (it refers to nothing)."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.btrim(c, F.lit(OUTER_SPACE))
    return F.when(t != "", F.upper(t))


def enum_value(c: Column | str) -> Column:
    """Lower case letters and digits only: ``' Sub-Sumption '`` and ``'SUBSUMPTION'`` are equal."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def newest_first(ts: Column | str) -> Column:
    """A key that sorts the latest time first and null last, independent of the session's time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    age = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") - ts.cast("timestamp_ntz")
    return F.coalesce(age, F.expr("INTERVAL '100000000 00:00:00' DAY TO SECOND"))
