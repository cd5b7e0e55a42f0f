"""String functions: identifiers from file names, normalisation, similarity, paragraphs, greedy chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE = 3000
CHUNK_MIN = 500
DOCUMENT_MIN = 100


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def sanitize_source_id(stem: Column | str) -> Column:
    """Word characters and ``-`` only, ``_`` runs collapsed, 80 characters, then no ``_`` at the ends."""
    s = F.regexp_replace(F.regexp_replace(_c(stem), r"(?U)[^\w\-]", "_"), "_+", "_")
    return F.btrim(F.substring(s, 1, 80), F.lit("_"))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def normalize_text(c: Column | str) -> Column:
    """Lower case, no punctuation, single blanks."""
    s = F.regexp_replace(F.lower(_c(c)), r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def string_similarity(a: Column | str, b: Column | str) -> Column:
    """0 if either is empty, 1 if equal when normalised, else 1 - distance / longer length."""
    a, b = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))
    x, y = normalize_text(a), normalize_text(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(1 - F.try_divide(F.levenshtein(x, y), longest))


def contains_any(text: Column | str, keywords) -> Column:
    """Whether any keyword is a substring."""
    text, out = _c(text), F.lit(False)
    for k in keywords:
        out = out | text.contains(k)
    return out


def contains_count(text: Column | str, keywords) -> Column:
    text, out = _c(text), F.lit(0)
    for k in keywords:
        out = out + text.contains(k).cast("int")
    return out


def first_keyword(text: Column | str, keywords, fold_case: bool = True) -> Column:
    """The first keyword, in the given order, that is a substring; null if none is."""
    text = F.lower(_c(text)) if fold_case else _c(text)
    return F.coalesce(*[F.when(text.contains(k.lower() if fold_case else k), F.lit(k)) for k in keywords])


#: Characters of a definition kept with candidates, in reports and in lists.
SHOWN_LENGTHS = {"stored": 200, "reported": 100, "listed": 80}


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def paragraphs(text: Column | str, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(_c(text), separator), strip), lambda x: x != "")


def sentences(paragraph: Column) -> Column:
    return F.split(paragraph, r"(?<=[.!?。！？])\s+")


def chunks(text: Column | str, size: int = CHUNK_SIZE, least: int = CHUNK_MIN, separator: str = r"\n\s*\n") -> Column:
    """Greedy packing of paragraphs into chunks of about ``size`` characters, as an array.

    A fold with the state (finished chunks, current parts, current length); lengths ignore separators. A paragraph
    longer than ``size`` ends the current chunk and is packed by sentences on its own; a chunk shorter than ``least``
    is appended to the one before it. One pass over the text inside the JVM.
    """
    empty = F.array().cast("array<string>")

    def state(done, cur, n):
        return F.struct(done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"))

    def flush(s, glue):
        return F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(F.array_join(s["cur"], glue)))).otherwise(s["done"])

    def pack(parts, glue, start):
        def step(s, p):
            full = (s["n"] + F.length(p) > size) & (F.size(s["cur"]) > 0)
            return F.when(full, state(flush(s, glue), F.array(p), F.length(p))).otherwise(state(s["done"], F.concat(s["cur"], F.array(p)), s["n"] + F.length(p)))

        return F.aggregate(parts, start, step)

    def paragraph(s, p):
        inner = pack(sentences(p), " ", state(flush(s, "\n\n"), empty, F.lit(0)))
        split = F.aggregate(F.array(inner), state(empty, empty, F.lit(0)), lambda _, x: state(flush(x, " "), empty, F.lit(0)))
        full = (s["n"] + F.length(p) > size) & (F.size(s["cur"]) > 0)
        plain = F.when(full, state(flush(s, "\n\n"), F.array(p), F.length(p))).otherwise(state(s["done"], F.concat(s["cur"], F.array(p)), s["n"] + F.length(p)))
        return F.when(F.length(p) > size, split).otherwise(plain)

    packed = F.aggregate(paragraphs(text, separator), state(empty, empty, F.lit(0)), paragraph, lambda s: flush(s, "\n\n"))

    def tail(acc, c):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n\n"), c)))
        return F.when((F.length(c) < least) & (F.size(acc) > 0), joined).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(packed, empty, tail)
