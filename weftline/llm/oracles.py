"""SQL of the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata

#: Values that say nothing, stated here apart from the operator's own list.
PLACEHOLDERS = (
    "n/a", "na", "n.a", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "empty", "tbd", "tba", "todo", "not available", "not applicable", "to be determined", "to be defined", "unspecified", "pending", "xxx",
    "不明", "なし", "無し", "無", "未記入", "未入力", "未定", "未設定", "該当なし", "記載なし", "未詳", "不詳", "空欄", "ｎ／ａ",
    "无", "未知", "不详", "暂无", "待定", "未填写", "未填", "没有", "待补充", "空",
)

_SPACE = "' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288)"


def _id(c: str) -> str:
    return f"nullif(upper(trim({c}, {_SPACE})), '')"


def _trim(c: str) -> str:
    return f"trim({c}, {_SPACE})"


def _fold(c: str) -> str:
    """Width folded by rule: voiced half-width Kana first, then every single form, lower case, no white space."""
    for mark in "ﾞﾟ":
        for base in range(0xFF66, 0xFF9E):
            full = unicodedata.normalize("NFKC", chr(base) + mark)
            if len(full) == 1:
                c = f"replace({c}, '{chr(base)}{mark}', '{full}')"
    wide = [chr(x) for x in range(0xFF01, 0xFFA0) if len(unicodedata.normalize("NFKC", chr(x))) == 1]
    plain = [unicodedata.normalize("NFKC", x) for x in wide]
    c = f"translate({c}, '{''.join(wide)}', '{''.join(plain).replace(chr(39), chr(39) * 2)}')"
    return f"nullif(lower(regexp_replace({c}, '[\\s\\x{{A0}}\\x{{3000}}]', '', 'g')), '')"


def _usable(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in PLACEHOLDERS)
    return f"(regexp_matches({x}, '[\\p{{L}}\\p{{N}}]') AND lower(regexp_replace({x}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) NOT IN ({words}))"


def _entries(c: str) -> str:
    return f"len(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {_trim('x')}), lambda y: y IS NOT NULL AND {_usable('y')})))"


_P1 = f"""
WITH one AS (SELECT * FROM (SELECT *, {_id('concept_id')} AS id, row_number() OVER (PARTITION BY {_id('concept_id')} ORDER BY loaded_at) AS rn FROM concept WHERE deleted_at IS NULL) WHERE rn = 1 AND id IS NOT NULL),
k AS (SELECT id, coalesce('e' || {_fold('en_name')}, 'j' || {_fold('jp_name')}) AS g, coalesce(t.trust, 0) AS trust, extraction_date,
      CASE WHEN {_usable(_trim('definition'))} THEN length({_trim('definition')}) ELSE 0 END AS definition, {_entries('four_axis')} AS four_axis, {_entries('context_quotes')} AS context_quotes, {_entries('source_papers')} AS source_papers
      FROM one LEFT JOIN provenance_trust t ON t.provenance = lower({_trim('one.provenance')})),
n AS (SELECT g, min(id) AS group_id FROM k WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1),
v AS (SELECT g, id, trust, extraction_date, field, content FROM (UNPIVOT (SELECT g, id, trust, extraction_date, definition::BIGINT AS definition, four_axis::BIGINT AS four_axis, context_quotes::BIGINT AS context_quotes, source_papers::BIGINT AS source_papers FROM k)
      ON definition, four_axis, context_quotes, source_papers INTO NAME field VALUE content) WHERE content > 0),
r AS (SELECT n.group_id, v.field, v.id, row_number() OVER (PARTITION BY v.g, v.field ORDER BY trust DESC, content DESC, extraction_date DESC NULLS LAST, id) AS rank FROM v JOIN n ON n.g = v.g)
SELECT group_id, field, id AS concept_id FROM r WHERE rank = 1
"""

def _kept(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {_trim('x')}), lambda y: y IS NOT NULL AND {_usable('y')}))), '|')"


_P1_TEXTS = _P1.replace("SELECT group_id, field, id AS concept_id FROM r WHERE rank = 1", f"""
, w AS (SELECT r.group_id, r.field, r.id, {_trim('definition')} AS definition, {_kept('four_axis')} AS four_axis, {_kept('context_quotes')} AS context_quotes, {_kept('source_papers')} AS source_papers FROM r JOIN one ON one.id = r.id WHERE r.rank = 1)
SELECT n.group_id, """ + ", ".join(f"max(CASE WHEN field = '{f}' THEN w.id END) AS {f}_from, max(CASE WHEN field = '{f}' THEN w.{f} END) AS {f}" for f in ("definition", "four_axis", "context_quotes", "source_papers")) + " FROM n LEFT JOIN w ON w.group_id = n.group_id GROUP BY 1")

_P2 = f"""
WITH cur AS (SELECT key, {_id('concept_b')} AS concept_b, score, row_number() OVER (PARTITION BY key ORDER BY generated_at DESC, score DESC NULLS LAST) AS rn
             FROM gaps WHERE key IS NOT NULL),
r AS (SELECT concept_b, score, key, row_number() OVER (PARTITION BY concept_b ORDER BY score DESC, key) AS rank
      FROM cur WHERE rn = 1 AND concept_b IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
"""

_P7 = f"""
WITH RECURSIVE p AS (SELECT {_id('concept_a.id')} AS a, {_id('concept_b.id')} AS b FROM merge_candidates WHERE regexp_replace(lower(action), '[^\\p{{L}}\\p{{N}}]', '', 'g') = 'merge'),
e AS (SELECT DISTINCT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y)
SELECT x AS concept_id, min(y) AS group_id FROM reach GROUP BY x
"""

ORACLES = {
    "p1_found": _P1,
    "p1_survivor_texts": _P1_TEXTS,
    "p2_found": _P2 + "SELECT concept_b, key FROM r WHERE rank <= 5",
    "p2_top_gaps": _P2 + "SELECT concept_b, score, key, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "p7_found": _P7,
}
