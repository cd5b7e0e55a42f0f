"""Explicit schemas of the project's files; JSON is never read by inference."""

from __future__ import annotations

CHUNK = "source_id STRING, source_file STRING, chunk_index INT, char_count INT, text STRING"
_TEXTS = "ARRAY<STRING>"
CONCEPT_FIELDS = {
    "concept_id": "STRING", "en_name": "STRING", "jp_name": "STRING", "zh_name": "STRING", "aliases": _TEXTS, "concept_type": "STRING", "definition": "STRING",
    "four_axis": _TEXTS, "source_papers": _TEXTS, "context_quotes": _TEXTS, "related_concepts": _TEXTS, "source_paper": "STRING", "country_tag": "STRING",
    "merge_history": "ARRAY<STRUCT<merged_from: STRING, merged_at: STRING, original_name: STRING>>",
}
CONCEPT = ", ".join(f"{k} {v}" for k, v in CONCEPT_FIELDS.items())
RELATIONSHIP = "source STRING, target STRING, type STRING, description STRING, inferred BOOLEAN"
CONCEPT_DB = (
    f"metadata STRING, sources ARRAY<STRING>, concepts ARRAY<STRUCT<{', '.join(f'{k}: {v}' for k, v in CONCEPT_FIELDS.items())}>>, "
    "relationships ARRAY<STRUCT<source: STRING, target: STRING, type: STRING, description: STRING, inferred: BOOLEAN>>"
)
EXTRACTION = (
    "source_id STRING, extraction_date STRING, concepts ARRAY<STRUCT<en_name: STRING, jp_name: STRING, zh_name: STRING, concept_type: STRING, "
    "definition: STRING, four_axis: ARRAY<STRING>, context_quotes: ARRAY<STRING>, source_papers: ARRAY<STRING>>>"
)
INFERRED = "relationships ARRAY<STRUCT<source: STRING, target: STRING, type: STRING, reasoning: STRING, similarity: STRUCT<embedding_cos: DOUBLE, heuristic_confidence: DOUBLE>>>"
MANUAL = "relationships ARRAY<STRUCT<category: STRING, edges: ARRAY<STRUCT<source: STRING, target: STRING, type: STRING>>>>"
MERGE_CANDIDATES = (
    "candidates ARRAY<STRUCT<concept_a: STRUCT<id: STRING, en_name: STRING, jp_name: STRING, definition: STRING, source_papers: ARRAY<STRING>>, "
    "concept_b: STRUCT<id: STRING, en_name: STRING, jp_name: STRING, definition: STRING, source_papers: ARRAY<STRING>>, "
    "similarity: STRUCT<embedding_cos: DOUBLE, method: STRING>, confidence: STRING, action: STRING>>"
)
EXAMPLE = "instruction STRING, input STRING, output STRING"
EDGE = "id STRING, source STRING, target STRING, type STRING, label STRING, width INT, style STRING, weight DOUBLE, inferred BOOLEAN, manual BOOLEAN"
