"""Queries of the general data-quality operators: orphan references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import forest, orphans
from weftline.session import cut_lineage, table


def _all_references(edges: DataFrame, concept: DataFrame) -> DataFrame:
    return orphans.references(orphans.ReferenceSet("edges", edges, "id", "created_at", ("source", "target"))).unionByName(
        orphans.references(orphans.ReferenceSet("concept", concept, "concept_id", "loaded_at", ("related_concepts",), array=True))
    )


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All references of the project's tables, and the reference state."""
    concept = table(spark, d, "concept")
    refs = _all_references(table(spark, d, "edges"), concept)
    state = orphans.apply_deltas(orphans.reference_deltas(refs), orphans.existence(concept, "concept_id", "loaded_at", "deleted_at"))
    return refs, state


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_references(spark, d))


BATCHES = 3


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """As ``p4_found``, from a state that is brought up to date batch by batch: the deliveries of one period after another."""
    state = known = None
    tables = [(table(spark, d, "edges"), "created_at"), (table(spark, d, "concept"), "loaded_at")]
    ends = [t.agg(F.min(c), F.max(c)).first() for t, c in tables]
    lo, hi = min((e[0] for e in ends if e[0]), default=None), max((e[1] for e in ends if e[1]), default=None)
    for i in range(BATCHES if lo else 1):
        def part(rows: DataFrame, time: str, i=i) -> DataFrame:
            if not lo:
                return rows
            after, until = (F.lit(lo + (hi - lo) * j / BATCHES) for j in (i, i + 1))
            inside = ((F.col(time) >= after) if i else F.lit(True)) & ((F.col(time) < until) if i < BATCHES - 1 else F.lit(True))
            return rows.where(inside | (F.col(time).isNull() & F.lit(i == 0)))

        e, c = (part(t, time) for t, time in tables)
        refs = _all_references(e, c)
        refs = orphans.news(refs, known) if known is not None else refs.withColumn("seen", F.lit(False))
        refs = cut_lineage(refs)
        parts = [orphans.reference_deltas(refs), orphans.existence(c, "concept_id", "loaded_at", "deleted_at", state)]
        state = cut_lineage(orphans.apply_deltas(*([state] if state is not None else []), *parts))
        known = orphans.earliest(*([known] if known is not None else []), refs)
    return orphans.orphan_report(known, state)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and status."""
    return orphans.orphan_counts(p4_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.hierarchies(forest.single_parent(forest.subsumption_links(table(spark, d, "edges"))))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its descendants and their distance."""
    return forest.descendants(p6_found(spark, d))


def p6_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendant_counts(p6_found(spark, d))


QUERIES = {
    "p4_found": p4_found,
    "p4_incremental": p4_incremental,
    "p4_report": p4_report,
    "p6_found": p6_found,
    "p6_descendants": p6_descendants,
    "p6_descendant_counts": p6_descendant_counts,
}

_SPACE = "' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288)"


def _id(c: str) -> str:
    return f"nullif(upper(trim({c}, {_SPACE})), '')"


_P4 = f"""
WITH con AS (SELECT {_id('concept_id')} AS id, min(loaded_at) AS loaded, max(CASE WHEN deleted_at IS NOT NULL THEN 1 ELSE 0 END) AS gone
             FROM concept GROUP BY 1),
e AS (SELECT {_id('id')} AS owner_id, {_id('source')} AS s, {_id('target')} AS t, min(created_at) AS seen FROM edges GROUP BY 1, 2, 3),
rc AS (SELECT {_id('concept_id')} AS owner_id, loaded_at, unnest(related_concepts) AS r FROM concept),
refs AS (SELECT 'edges' AS ref_table, owner_id, 'source' AS field, s AS ref_id, seen FROM e WHERE s IS NOT NULL
         UNION ALL SELECT 'edges', owner_id, 'target', t, seen FROM e WHERE t IS NOT NULL
         UNION ALL SELECT 'concept', owner_id, 'related_concepts', {_id('r')}, min(loaded_at) FROM rc WHERE {_id('r')} IS NOT NULL GROUP BY 2, 4),
st AS (SELECT ref_table, strftime(seen, '%Y-%m') AS period, owner_id, field, ref_id,
              CASE WHEN con.id IS NULL THEN 'missing' WHEN gone = 1 THEN 'deleted' WHEN loaded > seen THEN 'late' END AS status
       FROM refs LEFT JOIN con ON con.id = refs.ref_id)
"""

_P6 = f"""
WITH RECURSIVE l AS (SELECT {_id('source')} AS c, {_id('target')} AS p, created_at AS seen FROM edges
                     WHERE lower(regexp_replace(type, '[^A-Za-z]', '', 'g')) IN ('subsumption', 'isa')),
k AS (SELECT * FROM l WHERE c IS NOT NULL AND p IS NOT NULL),
par AS (SELECT c, p FROM (SELECT c, p, row_number() OVER (PARTITION BY c ORDER BY seen DESC, p) AS rn FROM k) WHERE rn = 1),
n AS (SELECT c AS id FROM k UNION SELECT p FROM k),
down AS (SELECT n.id AS node_id, n.id AS root_id, 0 AS depth, n.id AS path FROM n WHERE n.id NOT IN (SELECT c FROM par)
         UNION ALL SELECT par.c, down.root_id, down.depth + 1, down.path || '>' || par.c FROM down JOIN par ON par.p = down.node_id),
f AS (SELECT * FROM down UNION ALL SELECT id, 'CYCLE', -1, '' FROM n WHERE id NOT IN (SELECT node_id FROM down)),
d AS (SELECT unnest(string_split(path, '>')) AS node_id, node_id AS descendant_id, generate_subscripts(string_split(path, '>'), 1) AS i, depth FROM f WHERE depth > 0)
"""

ORACLES = {
    "p4_found": _P4 + "SELECT DISTINCT * FROM st WHERE status IS NOT NULL",
    "p4_incremental": _P4 + "SELECT DISTINCT * FROM st WHERE status IS NOT NULL",
    "p4_report": _P4 + "SELECT ref_table, period, field, status, count(*) AS orphans, count(DISTINCT ref_id) AS keys FROM (SELECT DISTINCT * FROM st WHERE status IS NOT NULL) GROUP BY ALL",
    "p6_found": _P6 + "SELECT * FROM f",
    "p6_descendants": _P6 + "SELECT node_id, descendant_id, CAST(depth - i + 1 AS INT) AS distance FROM d WHERE i <= depth",
    "p6_descendant_counts": _P6 + ", b AS (SELECT node_id, count(*) AS n, max(CAST(depth - i + 1 AS INT)) AS h FROM d WHERE i <= depth GROUP BY 1) SELECT f.node_id, coalesce(n, 0) AS descendants, CAST(coalesce(h, 0) AS INT) AS height FROM f LEFT JOIN b ON b.node_id = f.node_id",
}
