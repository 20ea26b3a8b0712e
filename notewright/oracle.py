"""The registered queries of the core in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from notewright.functions.text import BARE_ANALYTE, NUMERIC_CLAIM, SCORE_NAME, STOP_WORDS, SUFFIXES
from notewright.operators.graph import DECAY, LEAST_FLOW, SETTLED
from notewright.operators.lexical import B, FUSION_K, K1

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_STEM = " ".join(f"WHEN length(w) > 4 AND w LIKE '%{s}' THEN left(w, length(w) - {len(s)})" for s in SUFFIXES)


def _tokens(x: str) -> str:
    words = rf"string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    return f"coalesce(list_transform(list_filter({words}, lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)), lambda w: CASE {_STEM} ELSE w END), CAST([] AS VARCHAR[]))"


def _bag(tags: str = "tags") -> str:
    t, g = _tokens("title"), _tokens(f"array_to_string(list_filter(coalesce({tags}, CAST([] AS VARCHAR[])), lambda t: t IS NOT NULL), ' ')")
    c = _tokens("coalesce(content, '')")
    return f"list_concat(list_concat(list_concat(list_concat(list_concat({t}, {t}), {t}), {g}), {g}), {c})"


_LAST = "last_notes AS (SELECT * FROM notes WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY file_name DESC) = 1)"
_INDEX = f"idx AS (SELECT title, {_bag()} AS bag FROM last_notes)"
_EXACT = "low_titles AS (SELECT lower(title) AS low, max(title) AS title FROM last_notes GROUP BY 1)"
_EDGES = (
    f"{_EXACT}, one AS (SELECT DISTINCT n.title AS src, t.title AS dst FROM (SELECT title, unnest(links) AS link FROM last_notes) n JOIN low_titles t ON lower(n.link) = t.low WHERE n.title <> t.title), "
    "edges AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one)"
)


def _bm25(name: str, docs: str, asked: str = "concepts") -> str:
    """CTEs that end in ``name`` (query, doc, score); ``docs`` has title and bag."""
    return f"""
{name}_q AS (SELECT id AS query, term, count(*) AS times FROM (SELECT id, unnest({_tokens('title')}) AS term FROM {asked}) GROUP BY 1, 2),
{name}_n AS (SELECT count(*) AS n, avg(len(bag)) AS avg_len FROM {docs}),
{name}_p AS (SELECT title, l, term, count(*) AS f FROM (SELECT title, len(bag) AS l, unnest(bag) AS term FROM {docs}) GROUP BY 1, 2, 3),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name} AS (SELECT q.query, p.title AS doc, round(sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * ({K1} + 1) / (f + {K1} * (1 - {B} + {B} * l / avg_len))), 6) AS score
  FROM {name}_q q JOIN {name}_p p USING (term) JOIN {name}_d USING (term) CROSS JOIN {name}_n GROUP BY 1, 2)"""


def _top(source: str, k: int | None = None) -> str:
    """The k best of each query, or all, with their rank."""
    return f"SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM {source}" + (f" QUALIFY rank <= {k}" if k else "")


_SCORED = f"{_bm25('raw', 'idx')}, scored AS (SELECT query, doc, round(score / max(score) OVER (PARTITION BY query), 6) AS score FROM raw)"
_ONCE = "once AS (SELECT DISTINCT concept_id, ord, source, observed_on, detail, contradicts FROM evidence)"
_STRENGTH = """strength AS (SELECT concept_id,
  count(DISTINCT CASE WHEN NOT coalesce(contradicts, false) THEN nullif(trim(source), '') END) AS strength,
  count(DISTINCT CASE WHEN coalesce(contradicts, false) THEN nullif(trim(source), '') END) AS contradicting,
  min(nullif(observed_on, '')) AS first_seen, max(nullif(observed_on, '')) AS last_seen FROM once GROUP BY 1)"""
_NAMES = """names AS (SELECT name, arg_max(norm_id, ord * 10 + n) AS norm_id, arg_max(is_retired, ord * 10 + n) AS is_retired FROM (
  SELECT lower(trim(current)) AS name, id AS norm_id, false AS is_retired, ord, 0 AS n FROM norms
  UNION ALL SELECT lower(trim(a)), id, false, ord, 1 FROM (SELECT id, ord, unnest(aliases) AS a FROM norms)
  UNION ALL SELECT lower(trim(s.name)), id, true, ord, 2 FROM (SELECT id, ord, unnest(supersedes) AS s FROM norms)) WHERE name <> '' GROUP BY 1)"""
_MIGRATIONS = """moves AS (SELECT lower(trim(s.name)) AS name, current AS superseded_by FROM (SELECT current, ord, unnest(supersedes) AS s FROM norms)
  QUALIFY row_number() OVER (PARTITION BY lower(trim(s.name)) ORDER BY ord DESC) = 1)"""


def _rare(docs: str, jaccard: float) -> str:
    """CTEs that end in ``rare`` (src, dst, jaccard) of documents (title, bag)."""
    return f"""
r_sets AS (SELECT title AS doc, list_distinct(bag) AS s FROM {docs}),
r_terms AS (SELECT doc, unnest(s) AS term FROM r_sets),
r_rare AS (SELECT term FROM r_terms GROUP BY term HAVING count(*) BETWEEN 2 AND 400 AND count(*) <= (SELECT greatest(5, CAST(floor(count(*) * 0.02) AS INTEGER)) FROM r_sets)),
r_pairs AS (SELECT x.doc AS a, y.doc AS b FROM r_terms x JOIN r_terms y ON x.term = y.term AND x.doc < y.doc WHERE x.term IN (SELECT term FROM r_rare) GROUP BY 1, 2 HAVING count(*) >= 2),
r_inter AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) AS na, len(y.s) AS nb FROM r_pairs JOIN r_sets x ON x.doc = a JOIN r_sets y ON y.doc = b),
r_scored AS (SELECT a, b, round(i / (na + nb - i), 6) AS jaccard FROM r_inter WHERE round(i / (na + nb - i), 6) >= {jaccard}),
rare AS (SELECT src, dst, jaccard FROM (SELECT a AS src, b AS dst, jaccard FROM r_scored UNION ALL SELECT b, a, jaccard FROM r_scored)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY jaccard DESC, dst) <= 6)"""


_VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SIMS = f"{_VECTORS}, sims AS (SELECT q.vec_id AS query, r.vec_id AS doc, round(list_inner_product(q.e, r.e), 6) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)"
_NOTE_GRAPH = f"""
{_LAST}, {_EDGES}, {_SIMS},
knn AS (SELECT query, doc, score FROM sims WHERE score >= 0.30 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) <= 6),
near AS (SELECT a.title AS src, b.title AS dst, score FROM knn JOIN notes a ON a.note_id = query JOIN notes b ON b.note_id = doc WHERE a.title IS NOT NULL AND b.title IS NOT NULL),
halves AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, 1.0 AS weight, 'authored' AS kind, 1 AS f FROM one
  UNION ALL SELECT least(src, dst), greatest(src, dst), least(score, 0.85), 'inferred', 0 FROM near),
best AS (SELECT lo, hi, weight, kind FROM halves WHERE lo <> hi QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY f DESC, weight DESC) = 1),
g AS (SELECT lo AS src, hi AS dst, CAST(weight AS DOUBLE) AS weight, kind FROM best UNION ALL SELECT hi, lo, CAST(weight AS DOUBLE), kind FROM best)"""


def _activation() -> str:
    rounds = 1
    while DECAY**rounds >= LEAST_FLOW:
        rounds += 1
    flow = f"round(activation * {DECAY} * weight, 9)"
    parts = ["a0 AS (SELECT DISTINCT title AS seed, title AS node, CAST(1.0 AS DOUBLE) AS activation FROM notes WHERE note_id % 20 = 0 AND title IS NOT NULL)"]
    for n in range(1, rounds + 1):
        parts.append(
            f"a{n} AS (SELECT seed, node, max(activation) AS activation FROM (SELECT * FROM a{n - 1} UNION ALL SELECT seed, dst, {flow} FROM a{n - 1} JOIN g ON node = src WHERE {flow} >= {LEAST_FLOW}) GROUP BY 1, 2)"
        )
    kept = f"kept AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY activation DESC, node) AS rank FROM a{rounds} QUALIFY rank <= {SETTLED})"
    came = f"came AS (SELECT seed, dst AS node, src AS parent, kind FROM kept JOIN g ON node = src QUALIFY row_number() OVER (PARTITION BY seed, dst ORDER BY {flow} DESC, src DESC) = 1)"
    return f"WITH {_NOTE_GRAPH}, {', '.join(parts)}, {kept}, {came} SELECT k.seed, k.node, k.activation, CASE WHEN k.node <> k.seed THEN c.parent END AS parent, CASE WHEN k.node <> k.seed THEN c.kind END AS via FROM kept k LEFT JOIN came c ON c.seed = k.seed AND c.node = k.node"


def _spans(x: str) -> str:
    """List of value spans of a text."""
    find = lambda p: f"regexp_extract_all({x}, '(?i)({p})', 1)"
    analytes = rf"list_transform({find(BARE_ANALYTE)}, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')))"
    return f"list_distinct(list_concat(list_concat({find(NUMERIC_CLAIM)}, {find(SCORE_NAME)}), {analytes}))"


_UNESCAPE = r"CASE WHEN {x} = '\N' THEN '' ELSE replace(replace(replace(replace(replace({x}, '\\', chr(1)), '\n', chr(10)), '\t', chr(9)), '\r', chr(13)), chr(1), '\') END"
_MISSING = "list_filter(['age', 'duration', 'meds', 'workup', 'goal'], lambda k: NOT list_contains(list_filter([CASE WHEN kind <> '' THEN 'age' END, CASE WHEN observed_on <> '' THEN 'duration' END, CASE WHEN source <> '' THEN 'meds' END, CASE WHEN extracted_by <> '' THEN 'workup' END, CASE WHEN title <> '' THEN 'goal' END], lambda v: v IS NOT NULL), k))"
_KNOWN = "known AS (SELECT transcription_id AS id, list_sort(list(DISTINCT {'kind': lower(trim(pii_type)), 'value': trim(pattern)})) AS known FROM pii_patterns WHERE transcription_id IS NOT NULL AND length(trim(pattern)) >= 3 GROUP BY 1)"
_DISTINCT_T = "t AS (SELECT DISTINCT id, created_at, transcription, clinical_note FROM transcriptions)"
_JOIN = "array_to_string({}, '|')"
_DAYS = r"CASE WHEN regexp_matches(coalesce(volatility, ''), '(?i)^\s*\d+\s*(mo|m|d|y)\s*$') THEN CAST(regexp_extract(volatility, '(\d+)', 1) AS INTEGER) * CASE lower(regexp_extract(volatility, '\d+\s*([A-Za-z]+)', 1)) WHEN 'mo' THEN 30 WHEN 'm' THEN 30 WHEN 'y' THEN 365 ELSE 1 END ELSE 365 END"


def _slug(x: str, longest: int) -> str:
    return f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), {longest})"


SQL: dict[str, str] = {
    "tokenize_df": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "bm25_topk": f"WITH {_LAST}, {_INDEX}, {_bm25('raw', 'idx')} {_top('raw', 5)}",
    "rrf_fuse": f"WITH {_LAST}, {_INDEX}, t_idx AS (SELECT title, {_tokens('title')} AS bag FROM last_notes), {_bm25('whole', 'idx')}, {_bm25('short', 't_idx')}, "
    f"fused AS (SELECT query, doc, round(sum(1.0 / ({FUSION_K} + rank)), 6) AS score FROM (SELECT * FROM ({_top('whole')}) UNION ALL SELECT * FROM ({_top('short')})) GROUP BY 1, 2) {_top('fused', 10)}",
    "hybrid_search": f"WITH {_SIMS}, h_idx AS (SELECT doc_id AS title, {_tokens('text')} AS bag FROM documents), h_asked AS (SELECT doc_id AS id, text AS title FROM documents WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), "
    f"{_bm25('raw', 'h_idx', 'h_asked')}, others AS (SELECT query, doc, score FROM raw WHERE query <> doc), near AS (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) AS INTEGER) AS rank FROM sims), "
    f"fused AS (SELECT query, doc, round(sum(1.0 / ({FUSION_K} + rank)), 6) AS score FROM (SELECT query, doc, rank FROM ({_top('others')}) UNION ALL SELECT query, doc, rank FROM near) GROUP BY 1, 2) {_top('fused', 10)}",
    "search_expand": f"WITH {_LAST}, {_INDEX}, {_SCORED}, {_EDGES}, seeds AS ({_top('scored', 12)}), "
    f"both_ AS (SELECT query, doc, max(score) AS score FROM (SELECT query, doc, score FROM scored UNION ALL SELECT query, dst, round(score * 0.45, 6) FROM seeds JOIN edges ON doc = src) GROUP BY 1, 2) {_top('both_', 12)}",
    "dense_topk": f"WITH {_SIMS} SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) AS INTEGER) AS rank FROM sims QUALIFY rank <= 5",
    "knn_edges": f"WITH {_SIMS} SELECT query AS src, doc AS dst, score AS similarity FROM sims WHERE score >= 0.30 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) <= 6",
    "ingest_bands": f"WITH {_SIMS}, b AS (SELECT query, doc, score FROM sims WHERE doc % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) = 1) "
    "SELECT query, CASE WHEN score >= 0.40 THEN 'merge' WHEN score >= 0.32 THEN 'ambiguous' ELSE 'create' END AS action, CASE WHEN score >= 0.32 THEN doc ELSE -1 END AS target, score FROM b",
    "graph_stats": f"WITH {_LAST}, {_EDGES}, deg AS (SELECT n.title, count(e.dst) AS d FROM last_notes n LEFT JOIN edges e ON e.src = n.title GROUP BY 1) "
    "SELECT count(*) AS nodes, CAST(floor(sum(d) / 2) AS BIGINT) AS edges, round(avg(d), 2) AS avg_degree, count(*) FILTER (d = 0) AS isolated FROM deg",
    "hubs": f"WITH {_LAST}, {_EDGES} SELECT src AS node, count(*) AS degree FROM edges GROUP BY 1 ORDER BY degree DESC, node LIMIT 20",
    "link_histogram": f"WITH {_LAST}, {_EDGES} SELECT degree, count(*) AS nodes FROM (SELECT src, count(*) AS degree FROM edges GROUP BY 1) GROUP BY 1",
    "neighbours_d2": f"WITH {_LAST}, {_EDGES}, s AS (SELECT DISTINCT title AS seed FROM notes WHERE note_id % 20 = 0 AND title IS NOT NULL), "
    "h1 AS (SELECT DISTINCT seed, dst AS node FROM s JOIN edges ON src = seed WHERE dst <> seed), "
    "h2 AS (SELECT DISTINCT h1.seed, e.dst AS node FROM h1 JOIN edges e ON e.src = h1.node WHERE e.dst <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = e.dst)) "
    "SELECT seed, node, 1 AS hops FROM h1 UNION ALL SELECT seed, node, 2 FROM h2",
    "rare_token_links": f"WITH {_LAST}, {_INDEX}, {_rare('idx', 0.12)} SELECT src, dst, jaccard FROM rare",
    "weighted_graph": f"WITH {_NOTE_GRAPH} SELECT src, dst, weight, kind FROM g",
    "graph_kinds": f"WITH {_NOTE_GRAPH} SELECT kind, count(*) AS edges FROM g WHERE src < dst GROUP BY 1",
    "activation": _activation(),
    "link_exact": f"WITH {_LAST}, {_EXACT} SELECT DISTINCT l.link, t.title FROM (SELECT unnest(links) AS link FROM last_notes) l JOIN low_titles t ON lower(l.link) = t.low",
    "link_jaccard": f"WITH {_LAST}, {_EXACT}, l AS (SELECT DISTINCT link FROM (SELECT title AS link FROM concepts UNION ALL SELECT unnest(links) FROM notes) WHERE link IS NOT NULL AND lower(link) NOT IN (SELECT low FROM low_titles)), "
    f"ls AS (SELECT link, list_distinct({_tokens('link')}) AS s FROM l), ts AS (SELECT title, list_distinct({_tokens('title')}) AS s FROM last_notes), "
    "j AS (SELECT link, title, round(len(list_intersect(ls.s, ts.s)) / len(list_distinct(list_concat(ls.s, ts.s))), 6) AS jaccard FROM ls CROSS JOIN ts WHERE len(ls.s) > 0 AND len(ts.s) > 0) "
    "SELECT link, title, jaccard FROM j WHERE jaccard >= 0.34 QUALIFY row_number() OVER (PARTITION BY link ORDER BY jaccard DESC, title) = 1",
    "retriever_stats": f"WITH {_LAST}, {_EDGES}, o AS (SELECT count(t.title) AS resolved, count(*) - count(t.title) AS dangling FROM (SELECT unnest(links) AS link FROM last_notes) l LEFT JOIN low_titles t ON lower(l.link) = t.low WHERE l.link IS NOT NULL) "
    "SELECT (SELECT count(*) FROM last_notes) AS notes, (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM edges) AS edges, resolved, dangling, round(resolved / greatest(resolved + dangling, 1), 3) AS rate FROM o",
    "exact_merge": """WITH m AS (SELECT *, coalesce(length(content), 0) AS size FROM notes WHERE title IS NOT NULL),
base AS (SELECT title, content, nullif(observed_on, '') AS own_day FROM m QUALIFY row_number() OVER (PARTITION BY title ORDER BY size DESC, file_name) = 1),
rest AS (SELECT title, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, CAST([] AS VARCHAR[])))))), '|') AS tags, array_to_string(list_sort(list_distinct(flatten(list(coalesce(applies_norm, CAST([] AS VARCHAR[])))))), '|') AS applies_norm,
  coalesce(array_to_string(list(source_transcript ORDER BY file_name), '|'), '') AS sources, arg_min(nullif(observed_on, ''), file_name) FILTER (nullif(observed_on, '') IS NOT NULL) AS first_day, count(*) AS members FROM m GROUP BY 1)
SELECT title, content, tags, applies_norm, sources, coalesce(own_day, first_day) AS observed_on, members FROM base JOIN rest USING (title)""",
    "value_spans": f"SELECT span, count(*) FILTER (f = 't') AS transcripts, count(*) FILTER (f = 'n') AS notes FROM (SELECT unnest({_spans('transcription')}) AS span, 't' AS f FROM (SELECT DISTINCT id, transcription FROM transcriptions) "
    f"UNION ALL SELECT unnest({_spans('clinical_note')}), 'n' FROM (SELECT DISTINCT id, clinical_note FROM transcriptions)) GROUP BY 1",
    "note_validate": f"""SELECT note_id, array_to_string(list_filter([
  CASE WHEN coalesce(trim(title), '') = '' THEN 'empty title' END,
  CASE WHEN kind IS NULL OR kind NOT IN ('pattern', 'norm', 'vocabulary', 'protocol') THEN 'unknown kind' END,
  CASE WHEN kind IN ('pattern', 'vocabulary') AND regexp_matches(content, '(?i){SCORE_NAME}') THEN 'score name' END,
  CASE WHEN kind IN ('pattern', 'vocabulary') AND regexp_matches(content, '(?i){NUMERIC_CLAIM}') THEN 'numeric claim' END,
  CASE WHEN kind IN ('pattern', 'vocabulary') AND regexp_matches(content, '(?i){BARE_ANALYTE}') THEN 'bare analyte' END], lambda x: x IS NOT NULL), '|') AS errors FROM notes""",
    "norm_names": f"WITH {_NAMES}, u AS (SELECT norm_id, count(*) AS notes FROM (SELECT DISTINCT note_id, lower(trim(n)) AS norm_id FROM (SELECT note_id, unnest(applies_norm) AS n FROM notes)) GROUP BY 1) "
    "SELECT name, norm_id, is_retired, coalesce(notes, 0) AS notes FROM names LEFT JOIN u USING (norm_id)",
    "norm_lookup": f"WITH {_NAMES}, a AS (SELECT DISTINCT asked FROM (SELECT unnest(applies_norm) AS asked FROM notes) WHERE asked IS NOT NULL) "
    "SELECT a.asked, coalesce(i.id, n.norm_id) AS norm_id, CASE WHEN i.id IS NOT NULL THEN 'id' WHEN n.norm_id IS NOT NULL AND n.is_retired THEN 'retired name' WHEN n.norm_id IS NOT NULL THEN 'name' ELSE 'missing' END AS found_by "
    "FROM a LEFT JOIN norms i ON i.id = a.asked LEFT JOIN names n ON n.name = lower(trim(a.asked))",
    "norm_stale": f"WITH e AS (SELECT id, last_verified + CAST({_DAYS} AS INTEGER) AS expires_on FROM norms), u AS (SELECT id, count(*) AS notes FROM (SELECT DISTINCT note_id, unnest(applies_norm) AS id FROM notes) GROUP BY 1) "
    "SELECT e.id, strftime(expires_on, '%Y-%m-%d') AS expires_on, coalesce(notes, 0) AS notes FROM e LEFT JOIN u ON u.id = e.id WHERE expires_on IS NULL OR expires_on < DATE '2026-08-31'",
    "norm_search": r"""WITH h AS (SELECT id, ord, lower(concat_ws(' ', id, current, authority, notes, array_to_string(list_concat(list_concat([current], coalesce(aliases, CAST([] AS VARCHAR[]))), coalesce(list_transform(supersedes, lambda s: s.name), CAST([] AS VARCHAR[]))), ' '))) AS hay FROM norms),
q AS (SELECT DISTINCT query, lower(trim(query)) AS q FROM (SELECT unnest(applies_norm) AS query FROM notes) WHERE query IS NOT NULL),
s AS (SELECT query, id, ord, CAST(len(list_filter(string_split_regex(q, '[^a-z0-9_]+'), lambda t: length(t) > 2 AND contains(hay, t))) + CASE WHEN q <> '' AND contains(hay, q) THEN 3 ELSE 0 END AS DOUBLE) AS score FROM q CROSS JOIN h)
SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "norm_audit": f"WITH {_NAMES}, {_MIGRATIONS} SELECT d.doc_id, n.name AS found, n.norm_id, m.superseded_by FROM documents d JOIN names n ON regexp_matches(d.text, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(n.name) || '($|[^A-Za-z0-9_])') LEFT JOIN moves m ON m.name = n.name",
    "document_audit": f"WITH {_NAMES}, c AS (SELECT doc_id, unnest({_spans('coalesce(text, chr(32))')}) AS value FROM documents), "
    "loose AS (SELECT DISTINCT doc_id FROM c WHERE lower(trim(value)) NOT IN (SELECT name FROM names)), "
    "hit AS (SELECT DISTINCT d.doc_id FROM documents d JOIN names n ON n.is_retired AND regexp_matches(d.text, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(n.name) || '($|[^A-Za-z0-9_])')) "
    "SELECT count(*) AS notes, count(*) FILTER (l.doc_id IS NULL AND h.doc_id IS NULL) AS clean, count(h.doc_id) AS retired, count(l.doc_id) AS unmapped FROM documents d LEFT JOIN loose l USING (doc_id) LEFT JOIN hit h ON h.doc_id = d.doc_id",
    "name_audit": f"WITH {_NAMES} SELECT name, norm_id, is_retired, count(*) AS documents FROM documents d JOIN names n ON regexp_matches(d.text, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(n.name) || '($|[^A-Za-z0-9_])') GROUP BY 1, 2, 3",
    "vault_audit": f"WITH {_LAST}, {_NAMES}, v AS (SELECT title, unnest({_spans('coalesce(content, chr(32))')}) AS value FROM last_notes), "
    "l AS (SELECT title, array_to_string(list_sort(list(DISTINCT value)), '|') AS loose FROM v WHERE lower(trim(value)) NOT IN (SELECT name FROM names) GROUP BY 1), "
    "h AS (SELECT title, array_to_string(list_sort(list(DISTINCT name)), '|') AS corrections FROM last_notes JOIN names n ON n.is_retired AND regexp_matches(title || chr(10) || coalesce(content, ''), '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(n.name) || '($|[^A-Za-z0-9_])') GROUP BY 1) "
    "SELECT title, coalesce(corrections, '') AS corrections, coalesce(loose, '') AS loose FROM last_notes LEFT JOIN h USING (title) LEFT JOIN l USING (title)",
    "context_budget": f"WITH {_ONCE}, b AS (SELECT concept_id, ord, CAST(floor(length(coalesce(detail, '')) / 4) AS BIGINT) AS tokens FROM once), u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY concept_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM b) SELECT concept_id, ord, tokens, used FROM u WHERE used <= 300",
    "thin_context": f"SELECT note_id, array_to_string({_MISSING}, '|') AS missing, round((5 - len({_MISSING})) / 5, 2) AS coverage FROM notes",
    "concept_strength": f"WITH {_ONCE}, {_STRENGTH} SELECT concept_id, strength, contradicting, first_seen, last_seen FROM strength",
    "compounding": f"WITH {_ONCE}, {_STRENGTH}, r AS (SELECT id, coalesce(strength, 0) AS s, coalesce(contradicting, 0) AS c FROM concepts LEFT JOIN strength ON concept_id = id) "
    "SELECT count(*) AS concepts, CAST(sum(s) AS BIGINT) AS observations, round(sum(s) / count(*), 2) AS ratio, count(*) FILTER (s > 1) AS reinforced, count(*) FILTER (s <= 1) AS single, count(*) FILTER (c > 0) AS contested FROM r",
    "upper_median": "SELECT event_type, list_sort(list(value))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper_median, count(*) AS n FROM events GROUP BY 1",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1",
    "checkpoint_anti": "SELECT DISTINCT id FROM transcriptions WHERE id NOT IN (SELECT TRY_CAST(source_transcript AS BIGINT) FROM notes WHERE TRY_CAST(source_transcript AS BIGINT) IS NOT NULL)",
    "prepared": f"WITH {_DISTINCT_T}, {_KNOWN} SELECT id, strftime(created_at, '%Y-%m-%d') AS date, length(transcription) AS n_chars, coalesce(array_to_string(list_transform(known, lambda k: k.kind || '=' || k.value), '|'), '') AS known FROM t LEFT JOIN known USING (id) WHERE length(trim(coalesce(transcription, ''))) >= 120",
    "prepare_stats": f"WITH {_DISTINCT_T}, {_KNOWN}, r AS (SELECT length(trim(coalesce(transcription, ''))) >= 120 AS usable, known IS NOT NULL AS k, trim(coalesce(clinical_note, '')) <> '' AS n FROM t LEFT JOIN known USING (id)) "
    "SELECT count(*) AS total, count(*) FILTER (usable) AS usable, count(*) FILTER (usable AND k) AS with_known_pii, count(*) FILTER (usable AND n) AS with_notes FROM r",
    "source_page": "SELECT id, left(transcription, 240) AS preview FROM (SELECT DISTINCT id, transcription FROM transcriptions) WHERE length(trim(coalesce(transcription, ''))) >= 40 ORDER BY id LIMIT 5 OFFSET 10",
    "copy_fields": "WITH f AS (SELECT string_split(regexp_replace(raw, '\r$', ''), chr(9)) AS f FROM raw_transcriptions WHERE layout = 'copy') SELECT "
    + ", ".join(_UNESCAPE.format(x=f"f[{n}]") + f" AS {c}" for n, c in ((1, "id"), (3, "transcript"), (4, "notes"))) + " FROM f WHERE len(f) = 4",
    "unique_slugs": f"WITH s AS (SELECT note_id, {_slug(chr(99) + 'oalesce(title, chr(32))', 80)} AS slug FROM notes), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY note_id) AS n FROM s) SELECT note_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM n",
    "tag_index": "SELECT tag, count(*) AS notes FROM (SELECT DISTINCT note_id, lower(trim(t)) AS tag FROM (SELECT note_id, unnest(tags) AS t FROM notes)) WHERE tag <> '' GROUP BY 1",
    "tag_prefix_hits": "WITH s AS (SELECT note_id, lower(regexp_extract(title, '([A-Za-z]+)[^A-Za-z]*$', 1)) AS seed, list_transform(tags, lambda t: lower(t)) AS tags FROM notes) SELECT note_id, seed FROM s WHERE seed <> '' AND len(list_filter(tags, lambda t: contains(t, seed))) > 0",
    "note_markdown": "SELECT file_name, '---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'kind: ' || coalesce(kind, '') || chr(10) || 'tags: [' || array_to_string(list_transform(coalesce(tags, CAST([] AS VARCHAR[])), lambda t: '#' || t), ', ') || ']' || chr(10) || 'applies_norm: [' || array_to_string(coalesce(applies_norm, CAST([] AS VARCHAR[])), ', ') || ']' || chr(10) || 'source_transcript: ' || coalesce(source_transcript, '') || chr(10) || 'observed_on: ' || coalesce(observed_on, '') || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || '---' || chr(10) || chr(10) || 'Content: ' || coalesce(content, '') || chr(10) || 'Links: ' || array_to_string(list_transform(coalesce(links, CAST([] AS VARCHAR[])), lambda l: '[[' || l || ']]'), ' ') || chr(10) AS value FROM notes",
    "evidence_lines": f"WITH {_ONCE} SELECT concept_id, ord, '- [[' || coalesce(source, '') || ']]' || coalesce(' ' || nullif(trim(observed_on), ''), '') || CASE WHEN coalesce(contradicts, false) THEN ' — ⚠ CONTRADICTS' ELSE '' END || ' — ' || coalesce(detail, '') AS line FROM once",
    "content_digest": "SELECT sha256(text) AS digest, count(*) AS documents, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
}
SQL["audit_counts"] = "WITH v AS (" + SQL["vault_audit"] + ") SELECT count(*) AS notes, count(*) FILTER (corrections = '' AND loose = '') AS clean, count(*) FILTER (corrections <> '') AS retired, count(*) FILTER (loose <> '') AS unmapped FROM v"
_CSV_FIELD = '"(?:[^"]|"")*"|[^",]*'
#: Raw records by regular expressions: whether the quoting holds, the fields, and with quotes and escapes taken off the two typed ones.
_RAW = rf"""
raw_ AS (SELECT row_id, layout, regexp_replace(raw, '\r$', '') AS raw FROM raw_transcriptions),
cut_ AS (SELECT row_id, layout,
  CASE WHEN layout = 'csv' THEN regexp_full_match(raw, '(?s)(?:{_CSV_FIELD})(?:,(?:{_CSV_FIELD}))*') ELSE regexp_full_match(raw, '(?s)(?:[^\\]|\\.)*') END AS holds,
  CASE WHEN layout = 'csv' THEN regexp_extract_all(raw || ',', '(?s)({_CSV_FIELD}),', 1) ELSE regexp_extract_all(raw || chr(9), '(?s)((?:[^\\\t]|\\.)*)\t', 1) END AS f FROM raw_),
typed_ AS (SELECT *, CASE WHEN layout = 'csv' THEN regexp_replace(f[1], '(?s)^"(.*)"$', '\1') ELSE f[1] END AS id_,
  CASE WHEN layout = 'csv' THEN CASE WHEN f[2] <> '' THEN regexp_replace(f[2], '(?s)^"(.*)"$', '\1') END WHEN f[2] <> '\N' THEN f[2] END AS day_ FROM cut_),
judged_ AS (SELECT *, CASE WHEN NOT holds THEN 'quoting' WHEN len(f) <> 4 THEN 'columns'
  WHEN NOT regexp_full_match(id_, '[0-9]+') OR coalesce(TRY_CAST(id_ AS BIGINT), 0) < 1 THEN 'value'
  WHEN day_ IS NOT NULL AND (NOT regexp_full_match(day_, '\d{{4}}-\d\d-\d\d(?:[ T](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-]\d\d(?::?\d\d)?)?)?') OR TRY_CAST(left(day_, 10) AS DATE) IS NULL) THEN 'value' END AS reason FROM typed_)"""
SQL["p4_found"] = f"WITH {_RAW} SELECT row_id, reason FROM judged_ WHERE reason IS NOT NULL"
_LINE = r"(?s)^- \[\[(.*?)\]\](?: (\d{4}-\d{2}-\d{2}))?(?: [^—]*?)?( — ⚠ CONTRADICTS)? — (.*)$"
_PART = [f"regexp_extract(line, '{_LINE}', {n})" for n in range(1, 5)]
SQL["evidence_round_trip"] = (
    f"WITH l AS ({SQL['evidence_lines']}) SELECT concept_id, ord, {_PART[0]} AS source, nullif({_PART[1]}, '') AS observed_on, {_PART[2]} <> '' AS contradicts, {_PART[3]} AS detail FROM l WHERE regexp_matches(line, '{_LINE}')"
)
SQL["note_round_trip"] = "WITH m AS (" + SQL["note_markdown"] + r"""), p AS (SELECT file_name, trim(regexp_extract(value, '(?m)^title:[ \t]*(.+)$', 1)) AS title, coalesce(nullif(regexp_extract(value, '(?m)^kind:[ \t]*(\w+)', 1), ''), 'pattern') AS kind,
  regexp_replace(regexp_extract(value, '(?s)Content:(.*)\nLinks:', 1), '^\s+|\s+$', '', 'g') AS content, array_to_string(regexp_extract_all(value, '\[\[(.+?)\]\]', 1), '|') AS links, nullif(trim(regexp_extract(value, '(?m)^source:[ \t]*(.*)$', 1)), '') AS source FROM m)
SELECT file_name, title, kind, content, links, source FROM p WHERE title <> ''"""
#: One note of the batch after the other, with the list of those that became concepts.
SQL["ingest_actions"] = f"""WITH RECURSIVE {_VECTORS}, t AS (SELECT note_id FROM notes WHERE title IS NOT NULL),
i AS (SELECT note_id AS item, row_number() OVER (ORDER BY note_id) AS n FROM t JOIN v ON vec_id = note_id WHERE note_id % 20 = 0),
s AS (SELECT q.vec_id AS query, r.vec_id AS doc, round(list_inner_product(q.e, r.e), 6) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id JOIN t ON t.note_id = r.vec_id WHERE q.vec_id IN (SELECT item FROM i)),
near AS (SELECT item, n, list(struct_pack(doc := doc, score := score)) FILTER (doc IS NOT NULL) AS seen FROM i LEFT JOIN s ON query = item AND (doc % 20 <> 0 OR score >= 0.32) GROUP BY 1, 2),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS made, CAST(NULL AS BIGINT) AS item, CAST(NULL AS DOUBLE) AS best
  UNION ALL SELECT x.n, CASE WHEN x.best >= 0.40 THEN x.made ELSE list_append(x.made, x.item) END, x.item, x.best FROM (
    SELECT near.n, r.made, near.item, coalesce(list_max(list_transform(list_filter(near.seen, lambda y: y.doc % 20 <> 0 OR list_contains(r.made, y.doc)), lambda y: y.score)), 0) AS best FROM r JOIN near ON near.n = r.n + 1) x)
SELECT item, CASE WHEN best >= 0.40 THEN 'merge' WHEN best >= 0.32 THEN 'link' ELSE 'create' END AS action, CASE WHEN best >= 0.32 THEN best ELSE 0 END AS score FROM r WHERE item IS NOT NULL"""
