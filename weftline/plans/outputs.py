"""Queries of what a run writes and reports: round trips through sinks and sources, duplicates, manual edges, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import rules, text
from weftline.functions.ids import canonical_id, enum_value
from weftline.operators import cooccurrence, coverage, dedup, graph, hierarchy, maintain, ranking, reports
from weftline.plans import discovery as D
from weftline.plans import pipelines
from weftline.session import table, work_folder
from weftline.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict = {}
CON, EDG, CAND = D.CON, D.EDG, D.CAND
_PREP = f"WITH {CON}"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ sinks and sources, there and back


@query("SELECT source_id, chunk_index, CAST(char_count AS INT) AS char_count, text FROM (SELECT DISTINCT source_id, chunk_index, length(text) AS char_count, text FROM chunk WHERE text IS NOT NULL)")
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written by source and read again."""
    c = table(spark, d, "chunk").where("text IS NOT NULL").select("source_id", "chunk_index", F.length("text").alias("char_count"), "text").distinct()
    path = work_folder(spark, "chunks")
    writers.write_chunks(c, path)
    return readers.read_chunk_lines(spark, path).select("source_id", "chunk_index", "char_count", "text")


@query(f"{_PREP}, {D._COUNTRY} SELECT id, coalesce(country_tag, m.tag) AS country FROM ct")
def stored_version(spark: SparkSession, d: str) -> DataFrame:
    """A table written in two versions; the newest is read."""
    base = work_folder(spark, "versions")
    writers.write_version(D.concepts(spark, d).select("id", F.col("country_tag").alias("country")), base, "0001")
    writers.write_version(D.country_first_match(spark, d).select("id", "country"), base, "0002")
    return readers.read_newest(spark, base)


@query(D.ORACLES["training_json"].replace("SELECT id, '次の", "SELECT '次の"))
def stored_examples(spark: SparkSession, d: str) -> DataFrame:
    """Training examples as JSON lines, there and back."""
    path = work_folder(spark, "examples")
    writers.write_jsonl(D.training_json(spark, d).drop("id"), path)
    return spark.read.schema(schemas.EXAMPLE).json(path)


@query(f"{_PREP}, {D._IMPACT}, {D._AXIS}, {D._TR} SELECT imp.id, labels[1] AS primary_impact, dominant_axis, round((t + r + p) / 3, 2) AS transferability_score, (SELECT count(*) FROM con) AS count, 'impact' AS task FROM imp JOIN dom ON dom.id = imp.id JOIN tp ON tp.id = imp.id")
def stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions beside their metadata, there and back."""
    path = work_folder(spark, "predictions")
    p = pipelines.predict(D.concepts(spark, d), "id").select("id", "primary_impact", "dominant_axis", "transferability_score")
    writers.write_document(p, path, "predictions", task="impact")
    rows, meta = readers.read_stored_document(spark, path, "predictions", "id string, primary_impact string, dominant_axis string, transferability_score double", "count long, task string")
    return rows.crossJoin(F.broadcast(meta))  # one row


@query(f"{_PREP} SELECT coalesce(source_paper, source_papers[1], 'none') AS source_id, count(*) AS concepts, count(DISTINCT en_name) AS names FROM con GROUP BY 1")
def stored_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Extraction files, one to a folder, there and back; a file that is no JSON is set aside."""
    path = work_folder(spark, "extractions")
    source = F.coalesce("source_paper", F.get("source_papers", F.lit(0)), F.lit("none"))
    names = ("en_name", "jp_name", "zh_name", "concept_type", "definition", "four_axis", "context_quotes", "source_papers")
    docs = D.concepts(spark, d).groupBy(source.alias("source_id")).agg(F.collect_list(F.struct(*names)).alias("concepts"))  # a file holds one source
    docs.withColumn("folder", F.md5("source_id")).repartition("folder").write.partitionBy("folder").json(path)
    spark.createDataFrame([("{ broken",)], "value string").write.text(f"{path}/folder=broken")
    good, _ = readers.read_concept_files(spark, path)
    return good.groupBy("source_id").agg(F.count("*").alias("concepts"), F.countDistinct("en_name").alias("names"))


@query("SELECT 0 AS concepts, 0 AS relationships, 0 AS inferred")
def stored_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Sources that may be missing give empty tables."""
    path = work_folder(spark, "nothing")
    concepts, relationships = readers.read_concept_db(spark, f"{path}/db.json")
    one = [x.agg(F.count("*").cast("int").alias(n)) for n, x in (("concepts", concepts), ("relationships", relationships), ("inferred", readers.read_inferred(spark, f"{path}/inferred.json")))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


# ------------------------------------------------------------ vectors and duplicates

_GRAMS = "(SELECT id, CASE WHEN t = '' THEN 'unknown' ELSE t END AS t FROM (SELECT id, regexp_replace(coalesce(jp_name, '') || ' ' || coalesce(en_name, '') || ' ' || coalesce(definition, ''), '^[\\s\\x{A0}\\x{3000}]+|[\\s\\x{A0}\\x{3000}]+$', '', 'g') AS t FROM con))"


@query(
    f"{_PREP}, tx AS {_GRAMS}, gr AS (SELECT id, t, unnest(range(1, greatest(2, length(t) - 1))) AS i FROM tx), "
    "hs AS (SELECT id, CASE WHEN length(t) >= 3 THEN (unicode(substr(t, i, 1))::BIGINT * 31 + unicode(substr(t, i + 1, 1))) * 31 + unicode(substr(t, i + 2, 1)) WHEN length(t) = 2 THEN unicode(t)::BIGINT * 31 + unicode(substr(t, 2, 1)) ELSE unicode(t) END % 64 AS dim FROM gr) SELECT id, CAST(dim AS INT) AS dim, CAST(count(*) AS INT) AS n FROM hs GROUP BY ALL"
)
def concept_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all concepts, place by place."""
    v = dedup.embed(D.concepts(spark, d), "id")
    return v.select("id", F.posexplode("vec").alias("dim", "x")).where("x > 0").select("id", "dim", F.col("x").cast("int").alias("n"))


HIGH, MEDIUM, LOW = 0.45, 0.4, 0.35  # the vectors of the test table are far apart
_ALL = "cs AS (SELECT x.vec_id AS id_a, y.vec_id AS id_b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"
_TIERS = f"{_ALL}, tr AS (SELECT * FROM cs WHERE s >= {MEDIUM} UNION ALL (SELECT * FROM cs WHERE s >= {LOW} AND s < {MEDIUM} ORDER BY s DESC, id_a, id_b LIMIT 50)), tc AS (SELECT *, CASE WHEN s >= {HIGH} THEN 'high' WHEN s >= {MEDIUM} THEN 'medium' ELSE 'low' END AS confidence FROM tr)"


def _pairs(spark: SparkSession, d: str, least: float, upper: float | None = None) -> DataFrame:
    return dedup.cosine_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), least, upper)


@query(f"WITH {_ALL} SELECT id_a, id_b, round(s, 6) AS similarity FROM cs WHERE s >= {MEDIUM}")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors above a threshold."""
    return _pairs(spark, d, MEDIUM).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_ALL} SELECT id_a, id_b, round(s, 6) AS similarity FROM cs WHERE s >= 0.3 AND s < {LOW} ORDER BY s DESC, id_a, id_b LIMIT 1000")
def cosine_pairs_band(spark: SparkSession, d: str) -> DataFrame:
    """The best thousand of all pairs of a band, for the hierarchy."""
    b = _pairs(spark, d, 0.3, LOW).orderBy(F.col("similarity").desc(), "id_a", "id_b").limit(1000)
    return b.withColumn("similarity", F.round("similarity", 6))


def _tiered(spark: SparkSession, d: str) -> DataFrame:
    return dedup.tiers(_pairs(spark, d, LOW), HIGH, MEDIUM, LOW)


@query(f"WITH {_TIERS} SELECT id_a, id_b, round(s, 6) AS similarity, confidence, CASE WHEN confidence = 'high' THEN 'merge' ELSE 'review' END AS action FROM tc")
def duplicate_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the two upper tiers and the fifty best of the lower one."""
    return _tiered(spark, d).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_TIERS} SELECT (SELECT count(*) FROM embeddings) AS total_concepts, count(*) AS candidates, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low, 'vectors' AS method, {MEDIUM}::DOUBLE AS threshold FROM tc")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, method and threshold of the search for duplicates."""
    return dedup.duplicate_report(_tiered(spark, d), table(spark, d, "embeddings"), "vectors", MEDIUM)


@query(f"WITH {_TIERS} SELECT id_a, id_b, confidence FROM tc ORDER BY s DESC, id_a, id_b LIMIT 15")
def duplicate_top15(spark: SparkSession, d: str) -> DataFrame:
    return _tiered(spark, d).orderBy(F.col("similarity").desc(), "id_a", "id_b").limit(15).select("id_a", "id_b", "confidence")


@query(f"SELECT tier, count(*) AS pairs FROM (SELECT unnest(CASE lower(trim(confidence)) WHEN 'high' THEN ['high', 'medium', 'all'] WHEN 'medium' THEN ['medium', 'all'] ELSE ['all'] END) AS tier FROM merge_candidates) GROUP BY 1")
def merge_plans(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that a merge of each level of confidence would go through, without doing it."""
    m = table(spark, d, "merge_candidates")
    out = None
    for t in ("high", "medium", "all"):
        one = maintain.merge_plan(m, t).agg(F.count("*").alias("pairs")).select(F.lit(t).alias("tier"), "pairs")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------ edges


_MANUAL = f"""me AS (SELECT DISTINCT {D._id('source')} AS source, {D._id('target')} AS target, coalesce({D._enum('type')}, '') AS category FROM edges WHERE manual AND {D._id('source')} IS NOT NULL AND {D._id('target')} IS NOT NULL),
    oe AS (SELECT DISTINCT {D._id('source')} AS source, {D._id('target')} AS target FROM edges WHERE NOT coalesce(manual, false) AND {D._id('source')} IS NOT NULL AND {D._id('target')} IS NOT NULL),
    ok AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY category, source, target) AS rn FROM me WHERE source IN (SELECT id FROM con) AND target IN (SELECT id FROM con)),
    nw AS (SELECT * FROM ok WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM oe WHERE least(oe.source, oe.target) = least(ok.source, ok.target) AND greatest(oe.source, oe.target) = greatest(ok.source, ok.target)))"""


def _manual(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Old edges, new manual edges, missing ends, nodes."""
    e = table(spark, d, "edges").select(canonical_id("source").alias("source"), canonical_id("target").alias("target"), enum_value("type").alias("type"), F.coalesce("manual", F.lit(False)).alias("manual")).where("source IS NOT NULL AND target IS NOT NULL")
    old = e.where("NOT manual").select("source", "target").distinct()
    manual = e.where("manual").select(F.coalesce("type", F.lit("")).alias("category"), "source", "target", F.coalesce("type", F.lit("")).alias("type")).distinct()
    n = D.concepts(spark, d).select("id", F.coalesce("country_tag", F.lit(rules.DEFAULT_COUNTRY)).alias("country"))
    new, missing = maintain.add_manual_edges(old, manual, n.select("id"))
    return old, new, missing, n


@query(f"{_PREP}, {_MANUAL} SELECT category, count(*) AS added FROM nw GROUP BY 1")
def manual_added(spark: SparkSession, d: str) -> DataFrame:
    """Manual edges that are added, by category."""
    return _manual(spark, d)[1].groupBy("category").agg(F.count("*").alias("added"))


@query(f"{_PREP}, {_MANUAL} SELECT source, target, missing FROM (SELECT source, target, source AS missing FROM me WHERE source NOT IN (SELECT id FROM con) UNION SELECT source, target, target FROM me WHERE target NOT IN (SELECT id FROM con)) ORDER BY source, target, missing LIMIT 10")
def manual_missing_top10(spark: SparkSession, d: str) -> DataFrame:
    return _manual(spark, d)[2].select("source", "target", "missing").distinct().orderBy("source", "target", "missing").limit(10)


@query(
    f"{_PREP}, {_MANUAL}, n AS (SELECT id, coalesce(country_tag, 'CN') AS country FROM con), b AS (SELECT * FROM n WHERE id NOT IN (SELECT source FROM oe UNION SELECT target FROM oe)), "
    "a AS (SELECT * FROM b WHERE id NOT IN (SELECT source FROM nw UNION SELECT target FROM nw)) SELECT b.country, count(*) AS before, count(a.id) AS after FROM b LEFT JOIN a ON a.id = b.id GROUP BY 1"
)
def manual_isolated(spark: SparkSession, d: str) -> DataFrame:
    """Isolated concepts by country before and after the manual edges."""
    old, new, _, n = _manual(spark, d)
    adj = lambda e: graph.adjacency(e.select(F.col("source").alias("a"), F.col("target").alias("b")))
    before = n.join(graph.isolated(n.select("id"), adj(old)), "id", "left_semi")
    after = graph.isolated(before.select("id"), adj(new)).withColumn("still", F.lit(1))
    return before.join(after, "id", "left").groupBy("country").agg(F.count("*").alias("before"), F.count("still").alias("after"))


_LONE = "lone AS (SELECT id FROM con WHERE id NOT IN (SELECT source FROM edg UNION SELECT target FROM edg))"
_ORIENT = "ori AS (SELECT CASE WHEN relation = 'A_is_a_B' THEN id_a ELSE id_b END AS source, CASE WHEN relation = 'A_is_a_B' THEN id_b ELSE id_a END AS target, confidence FROM ver WHERE relation <> 'no_relation' AND confidence >= 0.3)"


def _lone(spark: SparkSession, d: str) -> DataFrame:
    return graph.isolated(D.concepts(spark, d).select("id"), graph.adjacency(D.edges(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"))))


@query(f"{_PREP}, {CAND}, {D._PAIR}, {D._HIER}, {EDG}, {_LONE}, {_ORIENT} SELECT id FROM lone INTERSECT SELECT x FROM (SELECT source AS x FROM ori UNION SELECT target FROM ori)")
def newly_connected(spark: SparkSession, d: str) -> DataFrame:
    """Isolated concepts that an inferred relation connects."""
    e = hierarchy.orient(D.verdicts(spark, d))
    return _lone(spark, d).intersect(e.select(F.explode(F.array("source", "target")).alias("id")))


@query(f"{_PREP}, {CAND}, {D._PAIR}, {D._HIER}, {_ORIENT} SELECT source, target, confidence FROM ori ORDER BY confidence DESC, source, target LIMIT 20")
def inferred_top20(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.orient(D.verdicts(spark, d)).select("source", "target", "confidence").orderBy(F.col("confidence").desc(), "source", "target").limit(20)


@query(f"{_PREP}, {CAND}, {D._PAIR}, {D._HIER}, {EDG}, {_LONE}, {_ORIENT} SELECT (SELECT count(*) FROM con) AS total_concepts, (SELECT count(*) FROM lone) AS isolated, count(*) AS inferred, count(*) FILTER (WHERE confidence >= 0.6) AS high, count(*) FILTER (WHERE confidence >= 0.4 AND confidence < 0.6) AS medium, count(*) FILTER (WHERE confidence < 0.4) AS low FROM ori")
def inferred_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of inferred relations by confidence."""
    e = hierarchy.orient(D.verdicts(spark, d))
    c = F.col("confidence")
    n = e.agg(F.count("*").alias("inferred"), F.count_if(c >= 0.6).alias("high"), F.count_if((c >= 0.4) & (c < 0.6)).alias("medium"), F.count_if(c < 0.4).alias("low"))
    one = D.concepts(spark, d).agg(F.count("*").alias("total_concepts")).crossJoin(_lone(spark, d).agg(F.count("*").alias("isolated")))  # one row each
    return one.crossJoin(n)


@query(
    f"{_PREP}, {CAND}, {D._PAIR}, {D._HIER}, {EDG}, {_LONE}, fl AS (SELECT id_a, id_b, cos, (id_a IN (SELECT id FROM lone) OR id_b IN (SELECT id FROM lone)) AS isolated FROM cand WHERE cos IS NOT NULL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY isolated ORDER BY cos DESC, id_a, id_b) AS rank FROM fl), ch AS (SELECT id_a, id_b FROM rk WHERE rank <= CASE WHEN isolated THEN 400 ELSE 100 END), "
    "inf AS (SELECT CASE WHEN relation = 'A_is_a_B' THEN id_a ELSE id_b END AS source, CASE WHEN relation = 'A_is_a_B' THEN id_b ELSE id_a END AS target, confidence FROM ver WHERE relation <> 'no_relation' AND confidence >= 0.4 AND (id_a, id_b) IN (SELECT (id_a, id_b) FROM ch)) "
    "SELECT source, target, confidence FROM inf WHERE NOT EXISTS (SELECT 1 FROM edg WHERE least(edg.source, edg.target) = least(inf.source, inf.target) AND greatest(edg.source, edg.target) = greatest(inf.source, inf.target))"
)
def hierarchy_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole inference: quotas with isolated ends first, heuristics, orientation, insertion."""
    pairs = D.candidate_pairs(spark, d).where("cos IS NOT NULL")
    return pipelines.infer_hierarchy(D.concepts(spark, d), pairs, D.edges(spark, d), "id").select("source", "target", "confidence")


@query()
def concept_update(spark: SparkSession, d: str) -> DataFrame:
    """The concept table after extractions without a date are taken as new; no SQL: ids follow the order of names."""
    cols = ("concept_id", "en_name", "jp_name", "zh_name", "concept_type", "definition", "country_tag", "related_concepts", "source_papers", "four_axis", "context_quotes")
    c = D.concepts(spark, d).withColumn("concept_id", F.col("id"))
    new = c.where("extraction_date IS NULL").select(*cols).withColumn("ord", F.col("concept_id"))
    out, _ = pipelines.update_concepts(c.where("extraction_date IS NOT NULL").select(*cols), new)
    return out.select("concept_id", "en_name", F.size("source_papers").alias("sources"), F.size("context_quotes").alias("quotes"))


# ------------------------------------------------------------ lists and reports


@query(f"WITH {D.KG}, {D.ADJ} SELECT src AS id, degree FROM deg WHERE degree > {D.HUB} ORDER BY degree DESC, src LIMIT 5")
def hub_top5(spark: SparkSession, d: str) -> DataFrame:
    return D.hub_nodes(spark, d).orderBy(F.col("degree").desc(), "id").limit(5)


@query(f"SELECT * FROM ({D.ORACLES['pair_jaccard']}) ORDER BY bridge_potential DESC, a, c LIMIT 10")
def pair_jaccard_top10(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_jaccard(spark, d).orderBy(F.col("bridge_potential").desc(), "a", "c").limit(10)


_RGB = ", ".join(f"CASE WHEN list_contains(coalesce(four_axis, []), '{a}') THEN len(list_filter(four_axis, lambda x: x = '{a}')) ELSE 0 END AS n{i}" for i, a in enumerate(rules.AXIS_RGB))
_MEAN = ", ".join("(" + " + ".join(f"n{i} * {c[k]}" for i, c in enumerate(rules.AXIS_RGB.values())) + ") // greatest(1, n0 + n1 + n2 + n3)" for k in range(3))


@query(f"{_PREP} SELECT id, CASE WHEN n0 + n1 + n2 + n3 = 0 THEN '{rules.NO_AXIS_COLOR}' ELSE printf('#%02x%02x%02x', {_MEAN}) END AS color FROM (SELECT id, {_RGB} FROM con)")
def node_colors(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(D.concepts(spark, d), "id").select("id", "color")


@query(
    f"{D._KS}, kn AS (SELECT least(x, y) AS x, greatest(x, y) AS y, min(p) AS text FROM (SELECT {D._id('concept_a')} AS x, {D._id('concept_c')} AS y, hypothesis_prompt AS p FROM gaps) WHERE x IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2), pr2 AS (SELECT DISTINCT a, c FROM sg) "
    "SELECT a, c, coalesce(text, a || ' × ' || c) AS hypothesis, CASE WHEN text IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM pr2 LEFT JOIN kn ON kn.x = least(a, c) AND kn.y = greatest(a, c)"
)
def hypothesis_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Known hypotheses of unlinked pairs in either order, else a generic one."""
    g = table(spark, d, "gaps").select(canonical_id("concept_a").alias("x"), canonical_id("concept_c").alias("y"), F.col("hypothesis_prompt").alias("p")).where("x IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL")
    known = g.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("p").alias("text")).withColumn("confidence", F.lit(0.9))
    return cooccurrence.lookup_hypotheses(D.scored_kg_gaps(spark, d).select("a", "c").distinct(), known)


@query("SELECT n_nationkey, round(400 + 180 * cos(n_nationkey * 2 * pi() / 25), 6) AS x, round(250 + 180 * sin(n_nationkey * 2 * pi() / 25), 6) AS y FROM nation")
def circular_places(spark: SparkSession, d: str) -> DataFrame:
    p = cooccurrence.circular_layout(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 25)
    return p.select("n_nationkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"{_PREP} SELECT id, left(definition, 200) AS stored, left(definition, 100) AS reported, left(definition, 80) AS listed FROM con")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    """Definitions at the lengths that are stored with candidates, reported and listed."""
    return D.concepts(spark, d).select("id", *[text.truncate("definition", n).alias(c) for c, n in text.SHOWN_LENGTHS.items()])


@query(D._AH + ", rr AS (SELECT *, row_number() OVER (PARTITION BY cross_country ORDER BY score DESC, a, b, c) AS rank FROM sg), cr AS (SELECT * FROM rr WHERE rank <= CASE WHEN cross_country THEN 15 ELSE 5 END) SELECT CAST(row_number() OVER (ORDER BY cross_country DESC, rank) AS INT) AS n, a_label, b_label, c_label, score, cross_country FROM cr")
def gap_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the report: between countries, then within, numbered through."""
    return reports.gap_rows(D.scored_part_gaps(spark, d)).select("n", "a_label", "b_label", "c_label", "score", "cross_country")


_RQ3 = f"{_PREP}, {D._TR}, r3 AS (SELECT tp.id, coalesce(con.jp_name, con.en_name) AS name, con.country_tag, CASE WHEN (t + r + p) / 3 > 0.6::DOUBLE THEN '{rules.TIERS[0]}' WHEN (t + r + p) / 3 > 0.4::DOUBLE THEN '{rules.TIERS[1]}' ELSE '{rules.TIERS[2]}' END AS recommendation, round((t + r + p) / 3, 2) AS score FROM tp JOIN con ON con.id = tp.id)"


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    c = D.concepts(spark, d).select("id", F.coalesce("jp_name", "en_name").alias("name"), "country_tag")
    return reports.with_tier(c.join(D.transfer_score_tiers(spark, d).select("id", "recommendation", F.col("transferability_score").alias("score")), "id"))


@query(_RQ3 + " SELECT recommendation, count(*) AS n FROM r3 GROUP BY 1")
def transfer_counts(spark: SparkSession, d: str) -> DataFrame:
    return _transfers(spark, d).groupBy("recommendation").agg(F.count("*").alias("n"))


@query(_RQ3 + " SELECT id, name, recommendation FROM r3 WHERE country_tag = 'JP'")
def transfer_home(spark: SparkSession, d: str) -> DataFrame:
    """All concepts of Japan with their recommendation."""
    return reports.home_rows(_transfers(spark, d))


@query(_RQ3 + " SELECT recommendation, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY recommendation ORDER BY score DESC, id) AS rank FROM r3) WHERE rank <= 10")
def transfer_first(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_in_group(_transfers(spark, d), "recommendation", [F.col("score").desc(), F.col("id")], 10).select("recommendation", "id", "rank")


@query(
    f"{_PREP}, {EDG}, {D._COV}, al AS (SELECT id FROM con WHERE id NOT IN (SELECT source FROM edg UNION SELECT target FROM edg)) "
    "SELECT * FROM (SELECT 'low density' AS list, source_id AS id FROM cov WHERE status = 'LOW_DENSITY' ORDER BY density, source_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'not processed', source_id FROM cov WHERE status = 'NOT_PROCESSED' ORDER BY source_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'isolated', id FROM al ORDER BY id LIMIT 20)"
)
def validation_lists(spark: SparkSession, d: str) -> DataFrame:
    """The lists of the validation report."""
    return reports.validation_rows(D.coverage_density(spark, d), _lone(spark, d))


@query(f"{_PREP}, s AS (SELECT DISTINCT s AS source_id FROM (SELECT unnest(list_concat(coalesce(source_papers, []), [source_paper])) AS s FROM con) WHERE s IS NOT NULL AND trim(s) <> '') SELECT source_id FROM s WHERE source_id NOT IN (SELECT source_id FROM chunk WHERE source_id IS NOT NULL)")
def sources_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sources that concepts name and no chunk has."""
    named = coverage.concepts_per_source(D.concepts(spark, d)).select("source_id")
    return named.join(table(spark, d, "chunk").select("source_id"), "source_id", "left_anti")
