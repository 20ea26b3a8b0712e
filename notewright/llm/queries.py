"""Queries of the numbered problems and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from notewright.llm import mixture, pii, setjoin, spans, survivors, tokens, turns
from notewright.session import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    notes, extractors, norms = (table(spark, d, t) for t in ("notes", "extractors", "norms"))
    return survivors.survivor_choices(notes, extractors, norms)


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    notes, extractors, norms = (table(spark, d, t) for t in ("notes", "extractors", "norms"))
    return survivors.survivor_records(notes, extractors, norms)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "transcriptions")).select("id", "turn_no", "speaker", "n_words")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "transcriptions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "notes")
    both = [setjoin.note_pairs(notes, f).select(F.lit(f).alias("facet"), "note_id_a", "note_id_b") for f in setjoin.FACETS]
    return both[0].unionByName(both[1])


def p3_between(spark: SparkSession, d: str) -> DataFrame:
    """Notes and concepts whose tags overlap as those of two notes in p3_found."""
    tables = [table(spark, d, t).select(k, setjoin.tag_set(F.col("tags")).alias("tags")) for t, k in (("notes", "note_id"), ("concepts", "id"))]
    pairs = setjoin.similar_between(tables[0], "note_id", "tags", tables[1], "id", "tags", 0.6, 3)
    return pairs.select(F.col("a").alias("note_id"), F.col("b").alias("concept_id"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per note and facet: its class of equal sets and the number of other classes it is linked to."""
    out = None
    for facet in setjoin.FACETS:
        one = setjoin.linked_classes(table(spark, d, "notes"), facet)
        out = one if out is None else out.unionByName(one)
    return out


def _pii_spans(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_spans(*(table(spark, d, t) for t in ("transcriptions", "pii_patterns", "person_names")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_values(_pii_spans(spark, d))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(_pii_spans(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


#: The domains of this project's sources, the upper level of the mixture's tree.
DOMAINS = {
    "vault_atomic": "knowledge", "norm_digest": "knowledge", "audit_remarks": "knowledge", "teaching_rounds": "knowledge",
    "encounter_dump": "encounters", "phone_triage": "encounters", "home_diary": "encounters",
    "clinic_letters": "correspondence", "ward_handover": "correspondence",
}


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.reached_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_lengths(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shared characters of each document as ranges."""
    return spans.shared_spans(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.fuzzy_passages(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


_QUERIES = (p1_found, p1_survivors, p2_found, p2_turns, p3_found, p3_between, p3_classes, p5_found, p5_redacted, p6_ids, p7_mix, p7_shares, p8_found, p8_spans, p8_passages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_TAGS = r"list_distinct(list_filter(list_transform(tags, lambda t: regexp_replace(lower(regexp_replace(regexp_replace(t, '^[\s#]+', ''), '\s+$', '')), '[\s_-]+', '-', 'g')), lambda t: t IS NOT NULL AND t <> ''))"
_WORDS = "list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))"


def _pairs_sql(facet: str, values: str, least: int, threshold: float) -> str:
    return f"""
SELECT '{facet}' AS facet, a AS note_id_a, b AS note_id_b FROM (
  SELECT x.note_id AS a, y.note_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared
  FROM (SELECT note_id, len(v) AS n, unnest(v) AS token FROM (SELECT note_id, {values} AS v FROM notes) WHERE len(v) >= {least}) x
  JOIN (SELECT note_id, len(v) AS n, unnest(v) AS token FROM (SELECT note_id, {values} AS v FROM notes) WHERE len(v) >= {least}) y
    ON x.token = y.token AND x.note_id < y.note_id
  GROUP BY 1, 2) WHERE shared >= {threshold} * (na + nb - shared) - 1e-9"""


_BETWEEN = f"""
WITH a AS (SELECT note_id, {_TAGS} AS v FROM notes), b AS (SELECT id AS concept_id, {_TAGS} AS v FROM concepts),
s AS (SELECT note_id, concept_id, len(list_intersect(a.v, b.v)) AS shared, len(a.v) AS na, len(b.v) AS nb FROM a JOIN b ON len(a.v) >= 3 AND len(b.v) >= 3)
SELECT note_id, concept_id FROM s WHERE shared >= 0.6 * (na + nb - shared) - 1e-9"""


#: Every window of 200 characters that stands in two documents, with the one before it in its text.
_WINDOWS = """
WITH w AS (
  SELECT doc_id, p, substr(text, p, 200) AS s
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM documents WHERE length(text) >= 200)),
c AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w WHERE s IN (SELECT s FROM c))"""
#: The characters that they cover, and the ranges of these.
_SHARED = f"""{_WINDOWS}
SELECT doc_id, CAST(sum(CASE WHEN before IS NULL THEN 200 ELSE least(200, p - before) END) AS BIGINT) AS shared_chars
FROM h GROUP BY doc_id"""
_RANGES = f"""{_WINDOWS},
n AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM h)
SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start, CAST(max(p) + 199 AS INTEGER) AS "end" FROM n GROUP BY doc_id, n.n"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": _SHARED,
        "p8_spans": _RANGES,
        "p3_between": _BETWEEN,
        "p3_found": _pairs_sql("tags", _TAGS, 3, 0.6) + "\nUNION ALL" + _pairs_sql("content", _WORDS, 30, 0.75),
    }
