"""Queries of the discovery operators over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, similarity, text
from weftline.functions.ids import canonical_id, enum_value
from weftline.operators import cooccurrence, coverage, dedup, graph, hierarchy, maintain, ranking
from weftline.session import table
from weftline.streaming.incremental import windowed_counts

QUANTITY = 40
HUB = 15
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ shared inputs


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """Live concepts, each once, by canonical id."""
    c = table(spark, d, "concept").where("deleted_at IS NULL").withColumn("id", canonical_id("concept_id")).where("id IS NOT NULL")
    return maintain.first_per(c, "id", F.col("loaded_at"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with canonical ends and type, both ends there, each (source, target, type) once."""
    e = table(spark, d, "edges").select(canonical_id("source").alias("source"), canonical_id("target").alias("target"), enum_value("type").alias("type"), "created_at")
    return e.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source", "target", "type").agg(F.min("created_at").alias("created_at"))


def kg_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(edges(spark, d))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_quantity") >= QUANTITY).select("l_orderkey", "l_partkey")


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts that occur in one order."""
    return cooccurrence.pairs_within(items(spark, d), "l_orderkey", "l_partkey")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as concepts: label, country (brand) and type."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("country"), F.col("p_type").alias("type"))


def _id(c: str) -> str:
    return f"nullif(upper(trim({c}, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288))), '')"


def _enum(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


CON = f"""con AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {_id('concept_id')} AS id, row_number() OVER (PARTITION BY {_id('concept_id')} ORDER BY loaded_at) AS rn
        FROM concept WHERE deleted_at IS NULL) WHERE rn = 1 AND id IS NOT NULL)"""
EDG = f"""edg AS (SELECT {_id('source')} AS source, {_id('target')} AS target, {_enum('type')} AS type, min(created_at) AS created_at FROM edges
        WHERE {_id('source')} IS NOT NULL AND {_id('target')} IS NOT NULL GROUP BY 1, 2, 3)"""
KG = EDG + """, pr AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edg WHERE source <> target)"""
PP = f"""it AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem WHERE l_quantity >= {QUANTITY}),
        pr AS (SELECT x.i AS a, y.i AS b, count(*) AS weight FROM it x JOIN it y ON x.g = y.g AND x.i < y.i GROUP BY 1, 2)"""
ADJ = "adj AS (SELECT a AS src, b AS dst FROM pr UNION ALL SELECT b, a FROM pr), deg AS (SELECT src, count(*) AS degree FROM adj GROUP BY 1)"
GAP = ADJ + """, gap AS (SELECT x.dst AS a, x.src AS b, y.dst AS c, deg.degree FROM adj x JOIN adj y ON x.src = y.src AND x.dst < y.dst JOIN deg ON deg.src = x.src
        WHERE deg.degree <= {hub} AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.a = x.dst AND pr.b = y.dst))"""
ALL = 1 << 30


def _any(t: str, ks) -> str:
    return "(" + " OR ".join(f"contains({t}, '{k}')" for k in ks) + ")"


def _count(t: str, ks) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, '{k}') AS INT)" for k in ks) + ")"


# ------------------------------------------------------------ text


@query(r"SELECT DISTINCT source_file, trim(left(regexp_replace(regexp_replace(regexp_replace(source_file, '\.[^.]*$', ''), '[^\p{L}\p{N}_\-]', '_', 'g'), '_+', '_', 'g'), 80), '_') AS source FROM chunk")
def sanitize_source(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("source_file")
    return table(spark, d, "chunk").select("source_file", text.sanitize_source_id(text.stem(f)).alias("source")).distinct()


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) >= 100")
def small_doc_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text") >= text.DOCUMENT_MIN).select("doc_id", F.length("text").cast("long").alias("chars"))


_SPACES = r"[\s\x{A0}\x{3000}]+"
_STRIP = f"regexp_replace(x, '^{_SPACES}|{_SPACES}$', '', 'g')"
_ITEM = "{'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': 0, 't': %s, 'k': %s}"
_PACK = f"""it AS (SELECT doc_id, flatten(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {_STRIP}), lambda x: x <> ''),
        lambda p: CASE WHEN length(p) > {text.CHUNK_SIZE} THEN list_concat([{_ITEM % ("''", "'open'")}], list_transform(string_split(regexp_replace(p, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_ITEM % ("s", "'s'")}), [{_ITEM % ("''", "'close'")}]) ELSE [{_ITEM % ("p", "'p'")}] END)) AS l FROM documents WHERE length(text) >= {text.DOCUMENT_MIN}),
    pk AS (SELECT doc_id, list_reduce(list_concat([{_ITEM % ("''", "'p'")}], l, [{_ITEM % ("''", "'open'")}]), lambda s, x: CASE
        WHEN x.k IN ('open', 'close') THEN {{'done': CASE WHEN len(s.cur) > 0 THEN list_append(s.done, CASE WHEN x.k = 'open' THEN array_to_string(s.cur, '\n\n') ELSE array_to_string(s.cur, ' ') END) ELSE s.done END, 'cur': []::VARCHAR[], 'n': 0, 't': '', 'k': x.k}}
        WHEN s.n + length(x.t) > {text.CHUNK_SIZE} AND len(s.cur) > 0 THEN {{'done': list_append(s.done, CASE WHEN x.k = 's' THEN array_to_string(s.cur, ' ') ELSE array_to_string(s.cur, '\n\n') END), 'cur': [x.t], 'n': CAST(length(x.t) AS INT), 't': '', 'k': x.k}}
        ELSE {{'done': s.done, 'cur': list_append(s.cur, x.t), 'n': CAST(s.n + length(x.t) AS INT), 't': '', 'k': x.k}} END).done AS d FROM it),
    tl AS (SELECT doc_id, list_reduce(list_concat([[]::VARCHAR[]], list_transform(d, lambda c: [c])), lambda a, c: CASE WHEN length(c[1]) < {text.CHUNK_MIN} AND len(a) > 0 THEN list_append(a[:-2], a[-1] || chr(10) || chr(10) || c[1]) ELSE list_concat(a, c) END) AS d FROM pk)"""


@query(f"WITH {_PACK} SELECT doc_id, CAST(generate_subscripts(d, 1) - 1 AS INT) AS chunk_index, unnest(d) AS text, length(unnest(d)) AS char_count FROM tl")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Greedy chunks of every document, numbered from 0."""
    docs = table(spark, d, "documents").where(F.length("text") >= text.DOCUMENT_MIN)
    return docs.select("doc_id", F.posexplode(text.chunks("text")).alias("chunk_index", "text")).withColumn("char_count", F.length("text"))


@query("SELECT source_id, count(*) AS chunks, sum(length(text)) AS chars, max(length(text)) AS longest FROM (SELECT DISTINCT source_id, chunk_index, text FROM chunk WHERE text IS NOT NULL) GROUP BY 1")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").where("text IS NOT NULL").select("source_id", "chunk_index", "text").distinct()
    return c.groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT count(DISTINCT source_id) AS sources, count(*) AS chunks, sum(length(text)) AS chars, round(count(*) / greatest(1, count(DISTINCT source_id)), 3) AS chunks_per_source FROM (SELECT DISTINCT source_id, chunk_index, text FROM chunk WHERE text IS NOT NULL)")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    s = chunk_stats(spark, d)
    return s.agg(F.count("*").alias("sources"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"), F.round(F.sum("chunks") / F.greatest(F.lit(1), F.count("*")), 3).alias("chunks_per_source"))


# ------------------------------------------------------------ rules

_DEF = "lower(coalesce(definition, ''))"
_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {_any('t', ks)} THEN '{label}' END" for ks, label, _ in rules.IMPACT) + "], lambda x: x IS NOT NULL)"
_IMPACT = f"imp AS (SELECT id, CASE WHEN len(l) > 0 THEN l ELSE ['{rules.DEFAULT_IMPACT[0]}'] END AS labels FROM (SELECT id, {_LABELS} AS l FROM (SELECT id, {_DEF} AS t FROM con)))"


def _definition() -> F.Column:
    return F.coalesce("definition", F.lit(""))


@query(f"WITH {CON}, {_IMPACT} SELECT id, array_to_string(labels, ',') AS labels, labels[1] AS primary_impact FROM imp")
def keyword_labels(spark: SparkSession, d: str) -> DataFrame:
    p = concepts(spark, d).select("id", rules.predict_impact(_definition()).alias("p"))
    return p.select("id", F.array_join(F.col("p.label"), ",").alias("labels"), F.col("p")[0]["label"].alias("primary_impact"))


@query(f"WITH {CON}, {_IMPACT} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM imp) GROUP BY 1")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).select(F.explode(rules.predict_impact(_definition())).alias("p")).groupBy(F.col("p.label").alias("label")).agg(F.count("*").alias("n"))


_TRAIN = "list_filter([" + ", ".join(f"CASE WHEN list_contains(coalesce(four_axis, []), '{a}') AND {_any('t', ks)} THEN {{'label': '{label}', 'confidence': {conf}::DOUBLE}} END" for a, ks, label, conf in rules.TRAIN_IMPACT) + ", CASE WHEN concept_type = 'mechanism' AND contains(t, '制限') THEN {'label': 'リスク_恣意的運用', 'confidence': 0.6::DOUBLE} END], lambda x: x IS NOT NULL)"


@query(
    f"WITH {CON}, tr AS (SELECT id, t, CASE WHEN len(l) > 0 THEN l ELSE [{{'label': '{rules.DEFAULT_IMPACT[0]}', 'confidence': 0.5::DOUBLE}}] END AS l FROM (SELECT id, t, {_TRAIN} AS l FROM (SELECT id, four_axis, concept_type, coalesce(definition, '') AS t FROM con))) "
    "SELECT id, '次の概念の企業影響を分類してください。' AS instruction, t AS input, '{\"labels\":[' || array_to_string(list_transform(l, lambda x: '\"' || x.label || '\"'), ',') || '],\"confidence\":[' || array_to_string(list_transform(l, lambda x: CAST(x.confidence AS VARCHAR)), ',') || ']}' AS output FROM tr"
)
def training_json(spark: SparkSession, d: str) -> DataFrame:
    """Training examples: the output is JSON in a string."""
    p = concepts(spark, d).select("id", _definition().alias("input"), rules.train_impact(_definition(), F.coalesce("four_axis", F.array().cast("array<string>")), F.coalesce("concept_type", F.lit(""))).alias("p"))
    return p.select("id", F.lit("次の概念の企業影響を分類してください。").alias("instruction"), "input", F.to_json(F.struct(F.col("p.label").alias("labels"), F.col("p.confidence").alias("confidence"))).alias("output"))


_SCORES = ", ".join(f"round(least(1.0, (CASE WHEN list_contains(coalesce(four_axis, []), '{rules.AXES[k]}') THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END) + 0.1::DOUBLE * {_count(_DEF, ks)}), 2) AS {k}" for k, ks in rules.AXIS_WORDS.items())
_AXIS = f"sc AS (SELECT id, {_SCORES} FROM con), dom AS (SELECT *, greatest(governance, data_flow, incentive, public_private) AS score, CASE greatest(governance, data_flow, incentive, public_private) WHEN governance THEN 'governance' WHEN data_flow THEN 'data_flow' WHEN incentive THEN 'incentive' ELSE 'public_private' END AS dominant_axis FROM sc)"


@query(f"WITH {CON}, {_AXIS} SELECT * FROM dom")
def axis_scores(spark: SparkSession, d: str) -> DataFrame:
    s = rules.axis_scores(_definition(), F.col("four_axis"))
    out = concepts(spark, d).select("id", *[c.alias(k) for k, c in s.items()])
    cols = {k: F.col(k) for k in s}
    return out.select("*", F.greatest(*cols.values()).alias("score"), rules.dominant_axis(cols).alias("dominant_axis"))


@query(f"WITH {CON}, {_AXIS} SELECT dominant_axis, count(*) AS n, round(avg(score), 4) AS mean FROM dom GROUP BY 1")
def dominant_axis_counts(spark: SparkSession, d: str) -> DataFrame:
    return axis_scores(spark, d).groupBy("dominant_axis").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query(f"WITH {CON}, {_AXIS} SELECT dominant_axis, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dominant_axis ORDER BY score DESC, id) AS rank FROM dom) WHERE rank <= 10")
def topk_per_axis(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_in_group(axis_scores(spark, d), "dominant_axis", [F.col("score").desc(), F.col("id")], 10).select("dominant_axis", "id", "score", "rank")


_TEXT = "coalesce(definition, '')"
_TRAINED = ", ".join(f"least(1.0, (CASE WHEN list_contains(coalesce(four_axis, []), '{rules.AXES[k]}') THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END) + CASE WHEN {_any(_TEXT, ks)} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) AS {k}" for k, ks in rules.TRAIN_AXIS.items())


@query(f"WITH {CON} SELECT id, {_TRAINED} FROM con")
def training_axis_scores(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).select("id", *[c.alias(k) for k, c in rules.train_axis_scores(_definition(), F.col("four_axis")).items()])


_TR = f"tf AS (SELECT id, {_any('t', rules.HARSH)} AS h, {_any('t', rules.TRANSPARENT)} AS o, {_any('t', rules.RELIEF)} AS r FROM (SELECT id, {_DEF} AS t FROM con)), tp AS (SELECT id, 0.5::DOUBLE + CASE WHEN o THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN h THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS t, 0.5::DOUBLE + CASE WHEN r THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS r, 0.5::DOUBLE - CASE WHEN h THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS p FROM tf)"


@query(f"WITH {CON}, {_TR} SELECT id, round(t, 2) AS transparency_score, round(r, 2) AS relief_score, round(p, 2) AS proportionality_score, round((t + r + p) / 3, 2) AS transferability_score, CASE WHEN (t + r + p) / 3 > 0.6::DOUBLE THEN '{rules.TIERS[0]}' WHEN (t + r + p) / 3 > 0.4::DOUBLE THEN '{rules.TIERS[1]}' ELSE '{rules.TIERS[2]}' END AS recommendation FROM tp")
def transfer_score_tiers(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).select("id", *[c.alias(k) for k, c in rules.transferability(_definition()).items()])


def _country_sql() -> str:
    cases = []
    for tag, lists in rules.COUNTRY.items():
        for col, ks in zip(("en", "jp", "src"), lists):
            field = {"en": "en_name", "jp": "jp_name", "src": "source"}[col]
            cases += [f"WHEN contains({col}, lower('{k}')) THEN {{'tag': '{tag}', 'reason': '{field} contains \"{k}\"'}}" for k in ks]
    return "CASE " + " ".join(cases) + f" ELSE {{'tag': '{rules.DEFAULT_COUNTRY}', 'reason': 'default'}} END"


_COUNTRY = f"ct AS (SELECT id, country_tag, {_country_sql()} AS m FROM (SELECT id, country_tag, lower(coalesce(en_name, '')) AS en, lower(coalesce(jp_name, '')) AS jp, lower(array_to_string(list_filter(list_concat(coalesce(source_papers, []), [source_paper]), lambda x: x IS NOT NULL), ' ')) AS src FROM con))"


@query(f"WITH {CON}, {_COUNTRY} SELECT id, m.tag AS tag, m.reason AS reason, coalesce(country_tag, m.tag) AS country FROM ct")
def country_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Inferred country with its reason; a tag that is there stays."""
    src = F.array_join(F.concat(F.coalesce("source_papers", F.array().cast("array<string>")), F.array("source_paper")), " ")
    m = concepts(spark, d).select("id", "country_tag", rules.country_match(F.col("en_name"), F.col("jp_name"), src).alias("m"))
    return m.select("id", F.col("m.tag").alias("tag"), F.col("m.reason").alias("reason"), F.coalesce("country_tag", "m.tag").alias("country"))


@query(f"WITH {CON}, {_COUNTRY} SELECT country, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ct), 1) AS percent FROM (SELECT coalesce(country_tag, m.tag) AS country FROM ct) GROUP BY 1")
def country_distribution(spark: SparkSession, d: str) -> DataFrame:
    return coverage.shares(country_first_match(spark, d), "country")


@query(f"WITH {CON}, {_IMPACT} SELECT label, split_part(label, '_', 1) AS category, id, CAST(rank AS INT) AS rank, n FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM (SELECT id, unnest(labels) AS label FROM imp)) WHERE rank <= 5")
def label_report(spark: SparkSession, d: str) -> DataFrame:
    """The first five concepts of every label, with the label's category and total."""
    rows = concepts(spark, d).select("id", F.explode(rules.predict_impact(_definition())).alias("p")).select("id", F.col("p.label").alias("label"))
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    return ranking.top_in_group(rows, "label", [F.col("id")], 5).join(n, "label").withColumn("category", F.substring_index("label", "_", 1))


_REC = rules.RECOMMEND


def _recommend_sql() -> str:
    parts_ = []
    for i, (_, _, yes, no, private) in enumerate(_REC):
        t = "coalesce(definition, '')"
        if private:
            y = f"(list_contains(coalesce(four_axis, []), '官民関係') OR {_any(t, ('民間', '企業', 'Alibaba', 'Tencent'))})"
            parts_.append(f"SELECT {i} AS condition, name, 'recommended' AS verdict FROM nm WHERE {y}")
        else:
            parts_.append(f"SELECT {i} AS condition, name, CASE WHEN {_any(t, yes)} THEN 'recommended' ELSE 'not_recommended' END AS verdict FROM nm WHERE {_any(t, yes)} OR {_any(t, no)}")
    return " UNION ALL ".join(parts_)


@query(
    f"WITH {CON}, nm AS (SELECT coalesce(jp_name, en_name, '') AS name, definition, four_axis FROM con), r AS (SELECT DISTINCT * FROM ({_recommend_sql()})), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY condition, verdict ORDER BY name) AS rank FROM r) SELECT CAST(condition AS INT) AS condition, verdict, name, CAST(rank AS INT) AS rank FROM k WHERE rank <= CASE WHEN verdict = 'recommended' THEN 5 ELSE 3 END"
)
def condition_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Concepts recommended, or not, under three fixed conditions: the first five and three by name."""
    t = _definition()
    name = F.coalesce("jp_name", "en_name", F.lit(""))
    verdicts = []
    for i, (_, _, yes, no, private) in enumerate(_REC):
        if private:
            v = F.when(F.coalesce(F.array_contains("four_axis", "官民関係"), F.lit(False)) | text.contains_any(t, ("民間", "企業", "Alibaba", "Tencent")), "recommended")
        else:
            v = F.when(text.contains_any(t, yes), "recommended").when(text.contains_any(t, no), "not_recommended")
        verdicts.append(F.struct(F.lit(i).alias("condition"), v.alias("verdict")))
    rows = concepts(spark, d).select(name.alias("name"), F.inline(F.array(*verdicts))).where("verdict IS NOT NULL").distinct()
    top = ranking.top_in_group(rows, ["condition", "verdict"], [F.col("name")], 5)
    return top.where(F.col("rank") <= F.when(F.col("verdict") == "recommended", 5).otherwise(3))


# ------------------------------------------------------------ entity resolution

_KEY = r"coalesce(nullif(regexp_replace(lower(coalesce(en_name, '')), '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g'), ''), nullif(regexp_replace(lower(coalesce(jp_name, '')), '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g'), ''))"


@query(
    f"WITH {CON}, k AS (SELECT {_KEY} AS key, id, concept_type, coalesce(source_papers, []) AS s, coalesce(four_axis, []) AS f FROM con) "
    "SELECT key, min(id) AS id, arg_min(concept_type, id) AS concept_type, count(*) AS records, array_to_string(list_sort(list_distinct(flatten(list(s)))), '|') AS source_papers, array_to_string(list_sort(list_distinct(flatten(list(f)))), '|') AS four_axis FROM k WHERE key IS NOT NULL GROUP BY key"
)
def concept_dedup_union(spark: SparkSession, d: str) -> DataFrame:
    """Records of equal names merged: first scalars, united sets."""
    c = concepts(spark, d).withColumn("concept_type", F.coalesce("concept_type", F.lit(None)))
    out = dedup.deduplicate(c, "id", ("id",), ("source_papers", "four_axis"))
    kinds = c.where("concept_type IS NOT NULL").withColumn("key", dedup.dedup_key(F.col("en_name"), F.col("jp_name"))).where("key IS NOT NULL").groupBy("key").agg(F.min_by("concept_type", "id").alias("concept_type"))
    return out.join(kinds, "key", "left").select("key", "id", "concept_type", "records", F.array_join("source_papers", "|").alias("source_papers"), F.array_join("four_axis", "|").alias("four_axis"))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name, 'SCS-' || lpad(CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 4, '0') AS concept_id FROM n")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return dedup.assign_ids(names, "name").select("name", "concept_id")


@query("WITH n AS (SELECT p_name AS name, count(*) AS m FROM part GROUP BY 1) SELECT x.name AS x, y.name AS y, round(1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name)), 6) AS similarity, x.m AS members_x, y.m AS members_y FROM n x JOIN n y ON x.name < y.name WHERE 1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name)) >= 0.6 - 1e-12")
def levenshtein_dups(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar names between classes of equal names, with the sizes of the classes."""
    return _name_dups(dedup.name_classes(table(spark, d, "part"), "p_partkey", "p_name"))


def _name_dups(classes: DataFrame) -> DataFrame:
    return dedup.similar_classes(classes, 0.6).select("x", "y", F.round("similarity", 6).alias("similarity"), "members_x", "members_y")


# The SQL's distance counts bytes: wide letters, all that is not ASCII in these names, become capitals, which none has.
_WIDE = "".join(chr(0xFF41 + i) for i in range(26))
_NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(en_name, '')), '[^\p{L}\p{M}\p{N}_\s\x{A0}\x{3000}]', '', 'g'), '[\s\x{A0}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(
    f"WITH {CON}, nm AS (SELECT norm, count(*) AS m, translate(norm, '{_WIDE}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS e FROM (SELECT {_NORM} AS norm FROM con) WHERE norm <> '' GROUP BY 1), "
    "q AS (SELECT x.norm AS x, y.norm AS y, 1 - levenshtein(x.e, y.e) / greatest(length(x.e), length(y.e)) AS s, x.m AS members_x, y.m AS members_y FROM nm x JOIN nm y ON x.norm < y.norm) SELECT x, y, round(s, 6) AS similarity, members_x, members_y FROM q WHERE s >= 0.6 - 1e-12"
)
def concept_name_dups(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar English names of live concepts, as ``levenshtein_dups``."""
    return _name_dups(dedup.name_classes(concepts(spark, d), "id", "en_name"))


def _part_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Parts stand for concepts."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("en_name"), F.lit(None).cast("string").alias("jp_name"), F.col("p_type").alias("definition"), F.col("p_type").alias("concept_type"), F.col("p_brand").alias("country_tag"), F.lit(None).cast("array<string>").alias("four_axis"))


@query(
    "WITH rep AS (SELECT p_name AS name, min(p_partkey) AS id, count(*) AS m, arg_min(p_type, p_partkey) AS t, arg_min(p_brand, p_partkey) AS c FROM part GROUP BY 1), "
    "q AS (SELECT x.id AS i, y.id AS j, x.m AS mi, y.m AS mj, 1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name)) AS ns, 1 - levenshtein(lower(x.t), lower(y.t)) / greatest(length(x.t), length(y.t)) AS ds, "
    "CASE WHEN x.t = y.t THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN x.c = y.c THEN 0.2::DOUBLE ELSE 0 END AS ss FROM rep x JOIN rep y ON x.id < y.id) "
    "SELECT i AS id_a, j AS id_b, mi AS members_a, mj AS members_b, round(0.5::DOUBLE * ns + 0.3::DOUBLE * ds + 0.2::DOUBLE * ss, 6) AS overall FROM q WHERE ns >= 0.4 - 1e-12 AND 0.5::DOUBLE * ns + 0.3::DOUBLE * ds + 0.2::DOUBLE * ss >= 0.6"
)
def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Likely duplicates among the first records of each name, as its SQL has it; ``duplicate_records`` has all."""
    return dedup.score_classes(dedup.name_representatives(_part_concepts(spark, d)), 0.6, 0.4).where("id_a <> id_b").select("id_a", "id_b", "members_a", "members_b", F.round("overall", 6).alias("overall"))


@query(
    "WITH rec AS (SELECT p_name AS name, lower(p_type) AS def, p_type AS t, p_brand AS c, min(p_partkey) AS id, count(*) AS m FROM part GROUP BY ALL), "
    "nn AS (SELECT x.name AS a, y.name AS b, 1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name)) AS s FROM (SELECT DISTINCT name FROM rec) x, (SELECT DISTINCT name FROM rec) y), "
    "dd AS (SELECT x.def AS a, y.def AS b, 1 - levenshtein(x.def, y.def) / greatest(length(x.def), length(y.def)) AS s FROM (SELECT DISTINCT def FROM rec) x, (SELECT DISTINCT def FROM rec) y), "
    "q AS (SELECT x.id AS i, y.id AS j, x.m AS mi, y.m AS mj, nn.s AS ns, dd.s AS ds, CASE WHEN x.t = y.t THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN x.c = y.c THEN 0.2::DOUBLE ELSE 0 END AS ss "
    "FROM rec x JOIN nn ON nn.a = x.name JOIN rec y ON y.name = nn.b JOIN dd ON dd.a = x.def AND dd.b = y.def WHERE x.id < y.id OR (x.id = y.id AND x.m > 1)) "
    "SELECT i AS id_a, j AS id_b, mi AS members_a, mj AS members_b, round(0.5::DOUBLE * ns + 0.3::DOUBLE * ds + 0.2::DOUBLE * ss, 6) AS overall FROM q WHERE ns >= 0.4 - 1e-12 AND 0.5::DOUBLE * ns + 0.3::DOUBLE * ds + 0.2::DOUBLE * ss >= 0.6"
)
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    """Likely duplicates among all records, by names, definitions and structure."""
    return dedup.duplicate_candidates(_part_concepts(spark, d)).select("id_a", "id_b", "members_a", "members_b", F.round("overall", 6).alias("overall"))


_COS = "cs AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)"


def _cosines(spark: SparkSession, d: str, least: float, upper: float | None = None) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dedup.cosine_search(v, v.where(F.col("id") % 20 == 0), least, upper)


@query(f"WITH {_COS} SELECT query, id, round(s, 6) AS similarity FROM cs WHERE s >= 0.4")
def cosine_dups(spark: SparkSession, d: str) -> DataFrame:
    """Vectors like a query: the queries are the ids divisible by 20, against all rows."""
    return _cosines(spark, d, 0.4).select("query", "id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_COS} SELECT CASE WHEN s >= 0.4 THEN 'high' WHEN s >= 0.35 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN s >= 0.4 THEN 'merge' ELSE 'review' END AS action, count(*) AS n FROM cs WHERE s >= 0.3 GROUP BY ALL")
def cosine_tiers(spark: SparkSession, d: str) -> DataFrame:
    t = similarity.similarity_tier(F.col("similarity"), 0.4, 0.35, 0.3)
    return _cosines(spark, d, 0.3).withColumn("tier", t).withColumn("action", similarity.tier_action(F.col("tier"))).groupBy("tier", "action").agg(F.count("*").alias("n"))


@query(f"WITH {_COS} SELECT query, id, round(s, 6) AS similarity FROM cs WHERE s >= 0.3 AND s < 0.35 ORDER BY s DESC, query, id LIMIT 1000")
def cosine_band(spark: SparkSession, d: str) -> DataFrame:
    """The best 1000 candidates of a band, for the hierarchy."""
    b = _cosines(spark, d, 0.3, 0.35).orderBy(F.col("similarity").desc(), "query", "id").limit(1000)
    return b.select("query", "id", F.round("similarity", 6).alias("similarity"))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different live concepts that are merge candidates, id_a < id_b, with the best cosine."""
    m = table(spark, d, "merge_candidates").select(canonical_id("concept_a.id").alias("x"), canonical_id("concept_b.id").alias("y"), F.col("similarity.embedding_cos").alias("s"))
    p = m.where("x <> y").groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max(F.when(~F.isnan("s"), F.col("s"))).alias("cos"))
    c = concepts(spark, d).select("id")
    return p.join(c.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(c.withColumnRenamed("id", "id_b"), "id_b", "left_semi")


CAND = f"""cand AS (SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, max(CASE WHEN NOT isnan(s) THEN s END) AS cos FROM (SELECT {_id('concept_a.id')} AS x, {_id('concept_b.id')} AS y, similarity.embedding_cos AS s FROM merge_candidates) WHERE x <> y
        AND x IN (SELECT id FROM con) AND y IN (SELECT id FROM con) GROUP BY 1, 2)"""
_PAIR = "pa AS (SELECT cand.*, a.concept_type AS ta, b.concept_type AS tb, a.country_tag AS ca, b.country_tag AS cb, coalesce(a.four_axis, []) AS fa, coalesce(b.four_axis, []) AS fb, lower(coalesce(a.jp_name, '')) AS ja, lower(coalesce(a.en_name, '')) AS ea, lower(coalesce(b.jp_name, '')) AS jb, lower(coalesce(b.en_name, '')) AS eb, lower(coalesce(a.definition, '')) AS da, lower(coalesce(b.definition, '')) AS db, coalesce(len(a.source_papers), 0) AS na, coalesce(len(b.source_papers), 0) AS nb FROM cand JOIN con a ON a.id = id_a JOIN con b ON b.id = id_b)"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    c = concepts(spark, d)
    s = F.struct("jp_name", "en_name", "definition", "concept_type", "country_tag", F.coalesce("four_axis", F.array().cast("array<string>")).alias("four_axis"), F.coalesce(F.size("source_papers"), F.lit(0)).alias("sources"))
    return candidate_pairs(spark, d).join(c.select(F.col("id").alias("id_a"), s.alias("a")), "id_a").join(c.select(F.col("id").alias("id_b"), s.alias("b")), "id_b")


@query(f"WITH {CON}, {CAND}, {_PAIR} SELECT id_a, id_b, round(CASE WHEN ta IS NOT DISTINCT FROM tb THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN ca IS NOT DISTINCT FROM cb THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN len(fa) > 0 AND len(fb) > 0 THEN 0.4::DOUBLE * len(list_distinct(list_intersect(fa, fb))) / (len(list_distinct(list_concat(fa, fb))) + (CASE WHEN list_contains(list_transform(list_concat(fa, fb), lambda x: x IS NULL), true) THEN 1 ELSE 0 END)) ELSE 0.0 END, 6) AS structural FROM pa")
def structural_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Type, country and axes of candidate pairs compared."""
    clean = lambda c: F.col(c)
    s = similarity.structural_similarity(F.col("a.concept_type"), F.col("b.concept_type"), F.col("a.country_tag"), F.col("b.country_tag"), clean("a.four_axis"), clean("b.four_axis"))
    return _paired(spark, d).select("id_a", "id_b", F.round(s, 6).alias("structural"))


def _in(x: str, y: str) -> str:
    return f"(length({x}) > 3 AND {y} <> '' AND contains({y}, {x}) AND {x} <> {y})"


def _h1(x: str) -> str:
    return f"CASE WHEN {_in(x, 'jb')} THEN 'B_is_a_A' WHEN {_in('jb', x)} THEN 'A_is_a_B' WHEN {_in(x, 'eb')} THEN 'B_is_a_A' WHEN {_in('eb', x)} THEN 'A_is_a_B' END"


def _rank(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TYPE_RANK.items()) + " ELSE 0 END"


_HIER = f"""hi AS (SELECT *, CASE WHEN ea = ja THEN {_h1('ja')} ELSE coalesce({_h1('ea')}, {_h1('ja')}) END AS r1,
    CASE WHEN (length(jb) > 3 AND contains(da, jb)) OR (length(eb) > 3 AND contains(da, eb)) THEN 'A_is_a_B' WHEN (length(ja) > 3 AND contains(db, ja)) OR (length(ea) > 3 AND contains(db, ea)) THEN 'B_is_a_A' END AS r2,
    CASE WHEN {_rank('ta')} > {_rank('tb')} THEN 'B_is_a_A' WHEN {_rank('ta')} < {_rank('tb')} THEN 'A_is_a_B' END AS r3,
    CASE WHEN na - nb >= 2 THEN 'B_is_a_A' WHEN nb - na >= 2 THEN 'A_is_a_B' END AS r4 FROM pa),
    ver AS (SELECT id_a, id_b, coalesce(r1, r2, r3, r4, 'no_relation') AS relation, CASE WHEN r1 IS NOT NULL THEN 0.7::DOUBLE WHEN r2 IS NOT NULL THEN 0.6::DOUBLE WHEN r3 IS NOT NULL THEN 0.4::DOUBLE WHEN r4 IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM hi)"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    # A generator keeps the large expression from being copied into every use of its fields.
    return _paired(spark, d).select("id_a", "id_b", F.inline(F.array(hierarchy.infer("a", "b"))))


@query(f"WITH {CON}, {CAND}, {_PAIR}, {_HIER} SELECT * FROM ver")
def hierarchy_heuristics(spark: SparkSession, d: str) -> DataFrame:
    """Is-a relation of candidate pairs by the cascade of heuristics."""
    return verdicts(spark, d).select("id_a", "id_b", "relation", "confidence")


@query(
    f"WITH {CON}, {CAND}, {_PAIR}, {_HIER}, {EDG}, inf AS (SELECT CASE WHEN relation = 'A_is_a_B' THEN id_a ELSE id_b END AS source, CASE WHEN relation = 'A_is_a_B' THEN id_b ELSE id_a END AS target, confidence FROM ver WHERE relation <> 'no_relation' AND confidence >= 0.4) "
    "SELECT source, target, confidence FROM inf WHERE NOT EXISTS (SELECT 1 FROM edg WHERE least(edg.source, edg.target) = least(inf.source, inf.target) AND greatest(edg.source, edg.target) = greatest(inf.source, inf.target))"
)
def inferred_edges(spark: SparkSession, d: str) -> DataFrame:
    """Inferred relations that are new to the graph."""
    new = hierarchy.orient(verdicts(spark, d))
    return hierarchy.merge_inferred(edges(spark, d), new).select("source", "target", "confidence")


@query(
    f"WITH {CON}, {CAND}, {EDG}, lone AS (SELECT id FROM con WHERE id NOT IN (SELECT source FROM edg UNION SELECT target FROM edg)), "
    "fl AS (SELECT id_a, id_b, cos, (id_a IN (SELECT id FROM lone) OR id_b IN (SELECT id FROM lone)) AS isolated FROM cand WHERE cos IS NOT NULL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY isolated ORDER BY cos DESC, id_a, id_b) AS rank FROM fl) SELECT id_a, id_b, isolated, CAST(rank AS INT) AS rank FROM r WHERE rank <= CASE WHEN isolated THEN 400 ELSE 100 END"
)
def isolated_first_quota(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with an isolated end first, by quotas."""
    lone = graph.isolated(concepts(spark, d).select("id"), graph.adjacency(edges(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"))))
    pairs = candidate_pairs(spark, d).where("cos IS NOT NULL")
    return hierarchy.isolated_first(pairs, lone, order=(F.col("cos").desc(), F.col("id_a"), F.col("id_b"))).select("id_a", "id_b", "isolated", "rank")


# ------------------------------------------------------------ graph


@query(f"WITH {PP} SELECT * FROM pr")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return part_pairs(spark, d)


@query(f"WITH it AS (SELECT l_partkey AS key, l_orderkey AS o, l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_quantity >= {QUANTITY}) SELECT key, count(DISTINCT o) AS sources, count(DISTINCT f) AS domains, count(*) AS contexts FROM it GROUP BY 1")
def node_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_quantity") >= QUANTITY)
    n = cooccurrence.roll_up(rows, F.col("l_partkey"), "l_orderkey", "l_returnflag", "l_linestatus", "l_orderkey")
    return n.select("key", "sources", "domains", "contexts")


@query(f"WITH {KG}, {ADJ} SELECT src AS id, degree FROM deg")
def adjacency_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.adjacency(kg_pairs(spark, d))).withColumnRenamed("src", "id")


@query(f"WITH {KG}, {ADJ} SELECT src AS id, degree FROM deg WHERE degree > {HUB}")
def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(graph.adjacency(kg_pairs(spark, d)), HUB).withColumnRenamed("src", "id")


@query(f"WITH {CON}, {EDG} SELECT id FROM con WHERE id NOT IN (SELECT source FROM edg UNION SELECT target FROM edg)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Concepts without any edge."""
    return graph.isolated(concepts(spark, d).select("id"), graph.adjacency(edges(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"))))


@query(f"WITH {CON}, {EDG}, rel AS (SELECT id, {_id('r')} AS r FROM (SELECT id, unnest(related_concepts) AS r FROM con)) SELECT id FROM con WHERE id NOT IN (SELECT source FROM edg UNION SELECT target FROM edg UNION SELECT id FROM rel WHERE r IS NOT NULL UNION SELECT r FROM rel WHERE r IS NOT NULL)")
def isolated_unmentioned(spark: SparkSession, d: str) -> DataFrame:
    """Concepts without edge that name no other and are named by none."""
    c = concepts(spark, d)
    related = c.select(F.col("id").alias("src"), F.explode("related_concepts").alias("r")).select("src", canonical_id("r").alias("dst")).where("dst IS NOT NULL")
    return graph.isolated(c.select("id"), graph.adjacency(edges(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"))), related)




@query(
    f"WITH {CON} SELECT id, coalesce(nullif(jp_name, ''), en_name, '') AS label, coalesce(concept_type, 'unknown') AS type, coalesce(country_tag, 'CN') AS country_tag, CAST(len(coalesce(source_papers, [])) * 5 + 10 AS INT) AS size FROM con"
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(concepts(spark, d), "id").select("id", "label", "type", "country_tag", "size")


@query(
    f"WITH {EDG} SELECT source || '-' || target AS id, coalesce(k, 'co_occurrence') AS type, CASE coalesce(k, 'co_occurrence') WHEN 'subsumption' THEN 3 WHEN 'implementation' THEN 2 WHEN 'causal' THEN 4 WHEN 'comparison' THEN 2 ELSE 1 END AS width, "
    "CASE coalesce(k, 'co_occurrence') WHEN 'implementation' THEN 'dashed' WHEN 'reference' THEN 'dashed' WHEN 'comparison' THEN 'dotted' WHEN 'co_occurrence' THEN 'dotted' ELSE 'solid' END AS style FROM (SELECT *, CASE type WHEN 'cooccurrence' THEN 'co_occurrence' WHEN 'isa' THEN 'subsumption' ELSE type END AS k FROM edg)"
)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("type") == "cooccurrence", "co_occurrence").when(F.col("type") == "isa", "subsumption").otherwise(F.col("type"))
    return graph.edge_projection(edges(spark, d).withColumn("type", kind).withColumn("description", F.lit(None).cast("string"))).select("id", "type", "width", "style")


def part_gaps(spark: SparkSession, d: str, hub: int | None = None) -> DataFrame:
    return graph.gaps(part_pairs(spark, d).select("a", "b"), hub)


_AG = f"WITH {PP}, {GAP.format(hub=ALL)}"
_AH = f"WITH {PP}, {GAP.format(hub=HUB)}, sg AS (SELECT gap.*, pa.p_name AS a_label, pb.p_name AS b_label, pc.p_name AS c_label, pa.p_brand <> pc.p_brand AS cross_country, round(1.0::DOUBLE + CASE WHEN pa.p_brand <> pc.p_brand THEN 2.0 ELSE 0.0 END + CASE WHEN pa.p_type <> pc.p_type THEN 0.5 ELSE 0.0 END + 1.0::DOUBLE / degree, 3) AS score FROM gap JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b JOIN part pc ON pc.p_partkey = c)"


@query(_AG + " SELECT a, b, c, degree FROM gap")
def abc_gaps(spark: SparkSession, d: str) -> DataFrame:
    """All unlinked pairs over every bridge."""
    return part_gaps(spark, d)


@query(_AG + " SELECT a, b, c, degree, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) || '-' || CAST(c AS VARCHAR) AS key FROM gap ORDER BY degree DESC, a, b, c LIMIT 50")
def abc_gaps_top50(spark: SparkSession, d: str) -> DataFrame:
    return part_gaps(spark, d).orderBy(F.col("degree").desc(), "a", "b", "c").limit(50).withColumn("key", graph.gap_key())


def scored_part_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps over bridges that are no hubs, with labels and scores."""
    found = graph.with_labels(part_gaps(spark, d, HUB), parts(spark, d), columns=("label", "country", "type"))
    return graph.score_gaps(found)


@query(_AH + " SELECT a, b, c, score, cross_country FROM sg")
def abc_gaps_scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_part_gaps(spark, d).select("a", "b", "c", "score", "cross_country")


_DIV = ", rk AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a, c) AS rn FROM sg), dv AS (SELECT * FROM rk WHERE rn <= 5 ORDER BY score DESC, a, b, c LIMIT 50)"


@query(_AH + _DIV + " SELECT a, b, c, a_label, b_label, c_label, score, cross_country FROM dv")
def abc_gaps_diversified(spark: SparkSession, d: str) -> DataFrame:
    """The best fifty gaps, at most five of one bridge."""
    return ranking.diversify(scored_part_gaps(spark, d)).select("a", "b", "c", "a_label", "b_label", "c_label", "score", "cross_country")


@query(_AH + _DIV + " SELECT count(*) AS gaps, count(DISTINCT b) AS bridges, count(DISTINCT a) AS a_ends, count(DISTINCT c) AS c_ends, count(*) FILTER (WHERE cross_country) AS cross_country FROM dv")
def gap_diversity_stats(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diversity(ranking.diversify(scored_part_gaps(spark, d)))


_KS = f"WITH {CON}, {KG}, {GAP.format(hub=HUB)}, sg AS (SELECT gap.*, coalesce(coalesce(x.country_tag, 'CN') <> coalesce(z.country_tag, 'CN'), false) AS cross_country, round(1.0::DOUBLE + CASE WHEN coalesce(x.country_tag, 'CN') <> coalesce(z.country_tag, 'CN') THEN 2.0 ELSE 0.0 END + CASE WHEN coalesce(x.concept_type, 'unknown') <> coalesce(z.concept_type, 'unknown') THEN 0.5 ELSE 0.0 END + 1.0::DOUBLE / degree, 3) AS score FROM gap JOIN con x ON x.id = a JOIN con y ON y.id = b JOIN con z ON z.id = c)"


def scored_kg_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the concept graph between live concepts, hubs left out as bridges."""
    n = graph.nodes(concepts(spark, d), "id").select("id", "label", F.col("country_tag").alias("country"), "type")
    found = graph.with_labels(graph.gaps(kg_pairs(spark, d), HUB), n, columns=("country", "type", "label"))
    return graph.score_gaps(found.where("a_country IS NOT NULL AND b_country IS NOT NULL AND c_country IS NOT NULL"))


@query(_KS + " SELECT a, b, c, score, cross_country FROM sg")
def kg_gaps_scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_kg_gaps(spark, d).select("a", "b", "c", "score", "cross_country")


@query(_KS + _DIV + " SELECT a, b, c, score, cross_country FROM dv")
def kg_gaps_diversified(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diversify(scored_kg_gaps(spark, d)).select("a", "b", "c", "score", "cross_country")


_TOP = ", tp AS (SELECT * FROM sg ORDER BY score DESC, a, b, c LIMIT 20), ax AS (SELECT tp.a, tp.b, tp.c, coalesce(x.four_axis, []) AS fa, coalesce(y.four_axis, []) AS fb, coalesce(z.four_axis, []) AS fc FROM tp JOIN con x ON x.id = tp.a JOIN con y ON y.id = tp.b JOIN con z ON z.id = tp.c), hy AS (SELECT a, b, c, list_sort(list_distinct(list_intersect(fa, fc))) AS sh, list_sort(list_distinct(list_filter(fb, lambda q: NOT list_contains(list_concat(fa, fc), q)))) AS br FROM ax)"


@query(_KS + _TOP + " SELECT a, b, c, CASE WHEN len(sh) > 0 THEN '共通軸' WHEN len(br) > 0 THEN '橋渡し' ELSE '探索的' END AS hypothesis_type, array_to_string(CASE WHEN len(sh) > 0 THEN sh ELSE br END, ',') AS axes FROM hy")
def shared_axes_type(spark: SparkSession, d: str) -> DataFrame:
    """Hypothesis type of the best twenty gaps by their axes."""
    return gap_hypotheses(spark, d).select("a", "b", "c", "hypothesis_type", "axes")


def _rq() -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any('t', ks)} THEN '{q}' END" for q, ks in rules.RESEARCH_QUESTIONS.items()) + "], lambda x: x IS NOT NULL)"


def _text(t: str) -> str:
    return f"coalesce({t}.jp_name, {t}.en_name, '') || ' ' || array_to_string(coalesce({t}.four_axis, []), ' ') || ' ' || coalesce({t}.definition, '')"


@query(
    _KS + _TOP + f", nm AS (SELECT tp.a, tp.b, tp.c, tp.score, coalesce(x.jp_name, x.en_name, tp.a) AS na, coalesce(y.jp_name, y.en_name, tp.b) AS nb, coalesce(z.jp_name, z.en_name, tp.c) AS nc, {_text('x')} || ' ' || {_text('y')} || ' ' || {_text('z')} AS t FROM tp JOIN con x ON x.id = tp.a JOIN con y ON y.id = tp.b JOIN con z ON z.id = tp.c), "
    f"rq AS (SELECT *, {_rq()} AS q FROM nm) SELECT rq.a, rq.b, rq.c, score, CASE WHEN len(sh) > 0 THEN '共通軸' WHEN len(br) > 0 THEN '橋渡し' ELSE '探索的' END AS hypothesis_type, array_to_string(CASE WHEN len(sh) > 0 THEN sh ELSE br END, ',') AS axes, "
    "'「' || na || '」と「' || nc || '」は「' || nb || '」を介して関連する可能性がある。' AS statement, array_to_string(q, ',') AS rq, CASE WHEN len(q) >= 2 THEN 'high' WHEN len(q) >= 1 THEN 'medium' ELSE 'low' END AS priority FROM rq JOIN hy ON hy.a = rq.a AND hy.b = rq.b AND hy.c = rq.c"
)
def gap_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses of the best twenty gaps with statement, research questions and priority."""
    c = concepts(spark, d).select("id", F.coalesce("jp_name", "en_name").alias("name"), "four_axis", "definition")
    return ranking.hypotheses(scored_kg_gaps(spark, d), c)


@query(
    f"WITH {PP}, {ADJ}, src AS (SELECT i AS key, list_sort(list(g)) AS s FROM it GROUP BY 1), cm AS (SELECT x.dst AS a, y.dst AS c, count(*) AS bridge_potential FROM adj x JOIN adj y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2) "
    "SELECT cm.a, cm.c, bridge_potential, round(bridge_potential / (da.degree + dc.degree - bridge_potential)::DOUBLE, 6) AS jaccard, CASE WHEN len(sa.s) <> len(sc.s) THEN 'high' ELSE 'medium' END AS novelty FROM cm JOIN deg da ON da.src = cm.a JOIN deg dc ON dc.src = cm.c JOIN src sa ON sa.key = cm.a JOIN src sc ON sc.key = cm.c WHERE sa.s <> sc.s AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.a = cm.a AND pr.b = cm.c)"
)
def pair_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Unlinked pairs by common neighbours."""
    src = cooccurrence.set_marks(items(spark, d), "l_partkey", "l_orderkey")
    p = cooccurrence.unlinked_pairs(part_pairs(spark, d).select("a", "b"), src)
    return p.withColumn("jaccard", F.round("jaccard", 6))


_NAMES = "nm AS (SELECT name, max(id) AS id FROM (SELECT id, trim(lower(unnest([en_name, jp_name, zh_name])), ' ' || chr(9) || chr(160) || chr(12288)) AS name FROM con) WHERE length(name) > 3 GROUP BY 1)"


@query(f"WITH {CON}, {_NAMES} SELECT con.id AS source, nm.id AS target, min(nm.name) AS name FROM con JOIN nm ON contains(lower(con.definition), nm.name) AND nm.id <> con.id GROUP BY 1, 2")
def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    """Definitions that mention another concept's name."""
    c = concepts(spark, d)
    names = c.select("id", F.explode(F.array("en_name", "jp_name", "zh_name")).alias("name")).where("name IS NOT NULL AND trim(name) <> ''")
    return maintain.mentions(names, c.select("id", F.col("definition").alias("text")))


_NEW = f"ex AS (SELECT DISTINCT source, target FROM edg WHERE type <> 'reference' OR type IS NULL), nw AS (SELECT source, target, created_at FROM edg WHERE type = 'reference')"


@query(f"WITH {EDG}, {_NEW} SELECT source, target FROM nw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.source = nw.source AND ex.target = nw.target)")
def edge_insert_directed(spark: SparkSession, d: str) -> DataFrame:
    """References that are new as directed edges."""
    e = edges(spark, d)
    return graph.insert_directed(e.where("type <> 'reference' OR type IS NULL"), e.where("type = 'reference'").select("source", "target"))


@query(
    f"WITH {EDG}, {_NEW}, k AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY created_at, source, target) AS rn FROM nw) SELECT source, target FROM k WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ex WHERE least(ex.source, ex.target) = least(k.source, k.target) AND greatest(ex.source, ex.target) = greatest(k.source, k.target))"
)
def edge_insert_undirected(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    new = e.where("type = 'reference'").select("source", "target", "created_at")
    return graph.insert_undirected(e.where("type <> 'reference' OR type IS NULL"), new, F.struct("created_at", "source", "target")).select("source", "target")


@query(f"WITH {CON}, {EDG}, e AS (SELECT DISTINCT source, target FROM edg) SELECT source, target, source AS missing FROM e WHERE source NOT IN (SELECT id FROM con) UNION ALL SELECT source, target, target FROM e WHERE target NOT IN (SELECT id FROM con)")
def referential_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Edges that name no live concept, with the missing end."""
    return graph.dangling(edges(spark, d).select("source", "target").distinct(), concepts(spark, d).select("id"))[1]


# ------------------------------------------------------------ maintenance


def stored_sources(spark: SparkSession, d: str) -> DataFrame:
    c = concepts(spark, d).where(F.size(F.coalesce("source_papers", F.array().cast("array<string>"))) > 0)
    jp, en = text.strip(F.coalesce("jp_name", F.lit(""))), F.lower(text.strip(F.coalesce("en_name", F.lit(""))))
    named = c.select(F.struct(jp.alias("jp"), en.alias("en")).alias("k"), "id", F.col("source_papers").alias("sources"))
    first = named.groupBy("k").agg(F.min("id").alias("ord"))
    return first.join(dedup.union_sets(named, "k", ("sources",)), "k").select("ord", "k.jp", "k.en", "sources")


_STORED = f"""nm AS (SELECT id, trim(coalesce(jp_name, ''), ' ' || chr(9) || chr(160) || chr(12288)) AS jp, lower(trim(coalesce(en_name, ''), ' ' || chr(9) || chr(160) || chr(12288))) AS en, coalesce(source_papers, []) AS s FROM con),
    st AS (SELECT jp, en, min(id) AS o, list_sort(list_distinct(list_filter(flatten(list(s)), lambda x: x IS NOT NULL))) AS s FROM nm WHERE len(s) > 0 GROUP BY 1, 2),
    nd AS (SELECT * FROM nm WHERE len(s) = 0),
    hit AS (SELECT nd.id, 0 AS step, o, st.s FROM nd JOIN st ON st.jp = nd.jp AND st.en = nd.en UNION ALL SELECT nd.id, 1, o, st.s FROM nd JOIN st ON st.jp = nd.jp AND nd.jp <> '' UNION ALL SELECT nd.id, 1, o, st.s FROM nd JOIN st ON st.en = nd.en AND nd.en <> ''),
    bst AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, o) AS rn FROM hit)"""


@query(f"WITH {CON}, {_STORED} SELECT id, array_to_string(s, '|') AS source_papers, CASE WHEN step = 0 THEN 'exact' ELSE 'partial' END AS how FROM bst WHERE rn = 1")
def restore_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Sources restored by both names, else by either."""
    r = maintain.restore_sources(concepts(spark, d), stored_sources(spark, d))
    return r.select("id", F.array_join(F.filter("source_papers", lambda x: x.isNotNull()), "|").alias("source_papers"), "how")


@query(f"WITH {CON}, {_STORED} SELECT id, array_to_string(s, '|') AS source_papers FROM bst WHERE rn = 1 AND step = 0")
def restore_exact(spark: SparkSession, d: str) -> DataFrame:
    return restore_fallback(spark, d).where("how = 'exact'").drop("how")


def merge_order(spark: SparkSession, d: str) -> DataFrame:
    """Merge pairs of the high tier in order of detection, each once."""
    m = maintain.merge_plan(table(spark, d, "merge_candidates"), "high").where(enum_value("action") == "merge")
    p = m.select(canonical_id("concept_a.id").alias("a"), canonical_id("concept_b.id").alias("b"), "detected_at").groupBy("a", "b").agg(F.min("detected_at").alias("t"))
    return p.select(F.concat_ws("|", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "a", "b").alias("ord"), "a", "b")


_MERGES = f"""mq AS (SELECT {_id('concept_a.id')} AS a, {_id('concept_b.id')} AS b, min(detected_at) AS t FROM merge_candidates WHERE lower(trim(confidence)) = 'high' AND {_enum('action')} = 'merge' GROUP BY 1, 2),
    mo AS (SELECT a, b, row_number() OVER (ORDER BY concat_ws('|', strftime(t, '%Y-%m-%d %H:%M:%S.%f'), a, b)) AS n FROM mq WHERE a <> b AND a IN (SELECT id FROM con) AND b IN (SELECT id FROM con)),
    st AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS gone UNION ALL SELECT mo.n, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, b) END FROM st JOIN mo ON mo.n = st.n + 1),
    won AS (SELECT a, b FROM mo JOIN st s ON s.n = mo.n JOIN st q ON q.n = mo.n - 1 WHERE len(s.gone) > len(q.gone)),
    up AS (SELECT b AS gone, a AS kept FROM won UNION ALL SELECT gone, won.a FROM up JOIN won ON won.b = up.kept),
    mp AS (SELECT gone, kept FROM up WHERE kept NOT IN (SELECT b FROM won))"""


@query(
    f"WITH RECURSIVE {CON}, {_MERGES}, ap AS (SELECT con.*, coalesce(kept, id) AS tgt, kept IS NOT NULL AS g FROM con LEFT JOIN mp ON gone = id), "
    f"rel AS (SELECT tgt, list_sort(list_distinct(list(r))) AS r FROM (SELECT tgt, coalesce(kept, r) AS r FROM (SELECT tgt, {_id('r')} AS r FROM (SELECT tgt, unnest(related_concepts) AS r FROM ap)) LEFT JOIN mp ON gone = r) WHERE r <> tgt GROUP BY 1), "
    "ag AS (SELECT tgt, max(CASE WHEN NOT g THEN en_name END) AS en_name, CAST(count(*) FILTER (WHERE g) AS INT) AS merged, array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_papers, []))))), '|') AS source_papers, CAST(least(5, len(list_distinct(flatten(list(coalesce(context_quotes, [])))))) AS INT) AS quotes FROM ap GROUP BY 1) "
    "SELECT ag.tgt AS id, en_name, merged, source_papers, quotes, coalesce(array_to_string(r, '|'), '') AS related_concepts FROM ag LEFT JOIN rel ON rel.tgt = ag.tgt WHERE merged > 0"
)
def merge_apply(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that took up others when the merge list is applied in order."""
    c = concepts(spark, d).select("id", "en_name", "jp_name", "definition", "four_axis", "source_papers", "context_quotes", F.transform("related_concepts", canonical_id).alias("related_concepts"))
    m = maintain.greedy_map(merge_order(spark, d), c.select("id"))
    out = maintain.apply_merges(c, m).where(F.size("merged") > 0)
    return out.select("id", "en_name", F.size("merged").alias("merged"), F.array_join("source_papers", "|").alias("source_papers"), F.size("context_quotes").alias("quotes"), F.array_join("related_concepts", "|").alias("related_concepts"))


@query(f"WITH RECURSIVE {CON}, {EDG}, {_MERGES} SELECT DISTINCT * FROM (SELECT coalesce(x.kept, source) AS source, coalesce(y.kept, target) AS target, type FROM edg LEFT JOIN mp x ON x.gone = source LEFT JOIN mp y ON y.gone = target) WHERE source <> target")
def merge_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Edges after the merges: ends replaced, loops dropped."""
    m = maintain.greedy_map(merge_order(spark, d), concepts(spark, d).select("id"))
    return maintain.redirect(edges(spark, d).select("source", "target", "type"), m)


# ------------------------------------------------------------ coverage

_COV = f"""ch AS (SELECT source_id, count(DISTINCT chunk_index) AS chunks FROM chunk GROUP BY 1),
    cs AS (SELECT s AS source_id, count(*) AS concepts FROM (SELECT unnest(list_concat(coalesce(source_papers, []), [source_paper])) AS s FROM con) WHERE s IS NOT NULL AND trim(s) <> '' GROUP BY 1),
    cov AS (SELECT ch.source_id, chunks, coalesce(concepts, 0) AS concepts, round(coalesce(concepts, 0) / chunks::DOUBLE, 3) AS density,
    CASE WHEN chunks > 0 AND coalesce(concepts, 0) = 0 THEN 'NOT_PROCESSED' WHEN coalesce(concepts, 0) / chunks::DOUBLE < 0.1 AND chunks > 5 THEN 'LOW_DENSITY' WHEN coalesce(concepts, 0) > 0 THEN 'OK' ELSE 'UNKNOWN' END AS status FROM ch LEFT JOIN cs ON cs.source_id = ch.source_id)"""


@query(f"WITH {CON}, {_COV} SELECT * FROM cov")
def coverage_density(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, concepts, density and status of every source."""
    return coverage.coverage(table(spark, d, "chunk"), concepts(spark, d))


@query(f"WITH {CON}, {_COV} SELECT count(*) AS sources, count(*) FILTER (WHERE concepts > 0) AS processed, sum(chunks) AS chunks, sum(concepts) AS concepts, round(sum(concepts) / sum(chunks)::DOUBLE, 3) AS average_density, round(count(*) FILTER (WHERE concepts > 0) * 100.0::DOUBLE / count(*), 1) AS processed_percent, count(*) FILTER (WHERE status = 'LOW_DENSITY') AS low_density, count(*) FILTER (WHERE status = 'NOT_PROCESSED') AS not_processed FROM cov")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_summary(coverage_density(spark, d))


# ------------------------------------------------------------ events


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by type; the same function runs on a stream with a watermark."""
    w = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))
