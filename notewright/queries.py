"""Registered queries of the core: each runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from notewright.functions import text as X
from notewright.operators import concepts as C, dense, graph, ingest, lexical, norms as N
from notewright.plans import api, audit, compile as compile_plan, distill, retrieve
from notewright.session import cut, spread, table
from notewright.sources import markdown, rejects

TODAY = "2026-08-31"
#: The similarities of the test vectors lie below those of encoders, and so do the limits here.
KNN, KNN_LEAST, MERGE_AT, LINK_AT = 6, 0.30, 0.40, 0.32
BUDGET = 300


def _joined(column: str):
    return F.array_join(column, "|")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The questions: the titles of all concepts."""
    return table(spark, d, "concepts").select("id", "title")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.note_index(table(spark, d, "notes"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved links between notes, exact, by spelling or by terms, both directions."""
    return graph.adjacency(cut(retrieve.note_links(C.last_by_title(table(spark, d, "notes"), "links"))))


def _queries_of(vectors: DataFrame) -> DataFrame:
    """The stated query set of vector searches: ids divisible by 20."""
    return vectors.filter("vec_id % 20 = 0")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejects(rejects.parse_rows(spread(table(spark, d, "raw_transcriptions"))))


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    return rejects.valid_rows(rejects.parse_rows(spread(table(spark, d, "raw_transcriptions"))))


def tokenize_df(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.tokens(F.col("text")).alias("bag"))
    return lexical.document_frequency(docs, "doc_id", "bag")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = lexical.bm25(_index(spark, d), "title", "bag", _asked(spark, d), "id", "title")
    return lexical.top_k(scored, 5)


def _title_bm25(spark: SparkSession, d: str) -> DataFrame:
    titles = C.last_by_title(table(spark, d, "notes"), "file_name").select("title", X.tokens(F.col("title")).alias("bag"))
    return lexical.bm25(titles, "title", "bag", _asked(spark, d), "id", "title")


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """The best 10 of both rankings fused; every scored note is ranked."""
    whole = lexical.ranks(lexical.bm25(_index(spark, d), "title", "bag", _asked(spark, d), "id", "title"))
    fused = lexical.fuse(whole, lexical.ranks(_title_bm25(spark, d)))
    return lexical.top_k(fused, 10)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense rankings of documents fused: an embedding belongs to the document of its id.

    Asked are the documents whose id is divisible by 20 and that have an embedding, by all their terms and
    their vector, against all texts and all vectors; every scored document is ranked before the fusion.
    """
    vectors = table(spark, d, "embeddings")
    texts = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    asked = texts.join(_queries_of(vectors).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    scored = lexical.bm25(texts.select("doc_id", X.tokens(F.col("text")).alias("bag")), "doc_id", "bag", asked, "doc_id", "text").filter("query <> doc")
    near = dense.nearest(vectors, _queries_of(vectors), vectors.count())  # the whole ordering
    return lexical.top_k(lexical.fuse(lexical.ranks(scored), near), 10)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return lexical.normalised(lexical.bm25(_index(spark, d), "title", "bag", _asked(spark, d), "id", "title"))


def search_expand(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.expand_once(_scored(spark, d), _edges(spark, d), 12)


def search_in_order(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.expand_in_order(cut(_scored(spark, d)), cut(_edges(spark, d)), 12)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return dense.nearest(vectors, _queries_of(vectors), 5)


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return dense.nearest(vectors, _queries_of(vectors), KNN, least=KNN_LEAST).select(F.col("query").alias("src"), F.col("doc").alias("dst"), F.col("score").alias("similarity"))


def ingest_bands(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    incoming = _queries_of(vectors)
    best = dense.nearest(vectors.filter("vec_id % 20 <> 0"), incoming, 1)
    return C.decide(best, "harness", MERGE_AT, LINK_AT).withColumn("target", F.coalesce("target", F.lit(-1)))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    nodes = C.last_by_title(table(spark, d, "notes"), "file_name").select(F.col("title").alias("node"))
    return graph.graph_stats(_edges(spark, d), nodes)


def hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(_edges(spark, d))


def link_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(_edges(spark, d))


def neighbours_d2(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "notes").filter("note_id % 20 = 0 AND title IS NOT NULL").select(F.col("title").alias("node")).distinct()
    return graph.neighbours(cut(_edges(spark, d)), seeds, 2)


def rare_token_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.rare_token_links(_index(spark, d).select("title", "bag"), "title", "bag")


def _note_graph(spark: SparkSession, d: str) -> DataFrame:
    """Notes tied by their resolved links and by the nearest vectors of the stated queries; a vector belongs to the note of its id."""
    notes = table(spark, d, "notes")
    authored = retrieve.note_links(C.last_by_title(notes, "links"))
    titles = notes.filter("title IS NOT NULL").select("note_id", "title")
    near = knn_edges(spark, d).withColumnsRenamed({"src": "a", "dst": "b"})
    inferred = near.join(titles.toDF("a", "src"), "a").join(titles.toDF("b", "dst"), "b").select("src", "dst", "similarity")
    return graph.weighted_graph(authored, inferred)


def weighted_graph(spark: SparkSession, d: str) -> DataFrame:
    return _note_graph(spark, d)


def graph_kinds(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_by_kind(_note_graph(spark, d))


def activation(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "notes").filter("note_id % 20 = 0 AND title IS NOT NULL").select(F.col("title").alias("node")).distinct()
    return graph.activation(cut(_note_graph(spark, d)), seeds)


def _note_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    last = C.last_by_title(table(spark, d, "notes"), "links")
    return last.select(F.col("title").alias("src"), F.explode("links").alias("link")).filter("link IS NOT NULL"), last.select("title")


def link_exact(spark: SparkSession, d: str) -> DataFrame:
    return graph.exact_links(*_note_links(spark, d))


def _concept_titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Links of notes, and titles of concepts as links, to be resolved to titles of notes."""
    links = table(spark, d, "concepts").select(F.col("title").alias("link")).unionByName(table(spark, d, "notes").select(F.explode("links").alias("link")))
    return links.filter("link IS NOT NULL").distinct(), C.last_by_title(table(spark, d, "notes"), "file_name").select("title")


def link_jaccard(spark: SparkSession, d: str) -> DataFrame:
    links, titles = _concept_titles(spark, d)
    return graph.jaccard_links(links.join(graph.exact_links(links, titles), "link", "left_anti"), titles)


def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_links(*_concept_titles(spark, d))


def retriever_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row: notes, edges, resolved and dangling link occurrences, share resolved; links of all three tiers."""
    links, titles = _note_links(spark, d)
    resolved = cut(graph.resolve_links(links, titles))
    ends = links.join(resolved, "link").select("src", F.col("title").alias("dst")).filter("src <> dst").distinct()
    edges = graph.adjacency(ends).agg(F.floor(F.count("*") / 2).cast("long").alias("edges"))
    found = links.join(resolved, "link", "left").agg(F.count("title").alias("resolved"), F.count_if(F.col("title").isNull()).alias("dangling"))
    out = titles.agg(F.count("*").alias("notes")).crossJoin(edges).crossJoin(found)  # one row each
    return out.withColumn("rate", F.round(F.col("resolved") / F.greatest(F.col("resolved") + F.col("dangling"), F.lit(1)), 3))


def exact_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = C.merge_titles(table(spark, d, "notes"))
    return merged.select("title", "content", _joined("tags").alias("tags"), _joined("applies_norm").alias("applies_norm"), _joined("sources").alias("sources"), "observed_on", "members")


def value_spans(spark: SparkSession, d: str) -> DataFrame:
    """Values in encounters' texts, and in how many transcripts and notes each stands."""
    rows = table(spark, d, "transcriptions").select("id", "transcription", "clinical_note").distinct()
    texts = [rows.select("id", F.col(c).alias("text")).distinct().select("id", F.explode(X.value_spans(F.col("text"))).alias("span"), F.lit(c).alias("field")) for c in ("transcription", "clinical_note")]
    in_field = lambda c: F.count_if(F.col("field") == c)
    return texts[0].unionByName(texts[1]).groupBy("span").agg(in_field("transcription").alias("transcripts"), in_field("clinical_note").alias("notes"))


def note_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notes")
    return rows.select("note_id", _joined_errors(rows).alias("errors"))


def _joined_errors(rows: DataFrame):
    return F.array_join(X.validation_errors(F.col("title"), F.col("kind"), F.col("content")), "|")


def norm_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name, and how many notes apply the norm that has it."""
    named = N.norm_names(table(spark, d, "norms"))
    used = table(spark, d, "notes").select("note_id", F.explode("applies_norm").alias("n")).select("note_id", F.lower(F.trim("n")).alias("norm_id")).distinct().groupBy("norm_id").agg(F.count("*").alias("notes"))
    return named.join(used, "norm_id", "left").select("name", "norm_id", "is_retired", F.coalesce("notes", F.lit(0)).alias("notes"))


def norm_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "notes").select(F.explode("applies_norm").alias("asked")).filter("asked IS NOT NULL")
    return N.lookup(asked, "asked", table(spark, d, "norms"))


def norm_stale(spark: SparkSession, d: str) -> DataFrame:
    """Stale norms, and how many notes apply each."""
    late = N.stale(table(spark, d, "norms"), TODAY)
    used = table(spark, d, "notes").select("note_id", F.explode("applies_norm").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("notes"))
    return late.join(used, "id", "left").select("id", F.date_format("expires_on", "yyyy-MM-dd").alias("expires_on"), F.coalesce("notes", F.lit(0)).alias("notes"))


def norm_search(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "notes").select(F.explode("applies_norm").alias("query")).filter("query IS NOT NULL")
    return N.search(table(spark, d, "norms"), asked)


def norm_audit(spark: SparkSession, d: str) -> DataFrame:
    """Names of norms, current and retired, as words in the texts of documents."""
    found = N.audit(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, d, "norms"), retired_only=False)
    return found.select("doc_id", "found", "norm_id", "superseded_by")


def document_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, those with retired names, with values that no norm covers, and with neither; the source stands for the title."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"), F.col("source").alias("file_name"))
    return audit.audit_counts(audit.vault_audit(docs, table(spark, d, "norms")))


def name_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every name of a norm, retired or not, in the texts of documents."""
    norms = table(spark, d, "norms")
    found = N.audit(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", norms, retired_only=False)
    counts = found.groupBy(F.col("found").alias("name")).agg(F.count("*").alias("documents"))
    return counts.join(N.norm_names(norms), "name").select("name", "norm_id", "is_retired", "documents")


def vault_audit(spark: SparkSession, d: str) -> DataFrame:
    out = audit.vault_audit(table(spark, d, "notes"), table(spark, d, "norms"))
    return out.select("title", _joined("corrections").alias("corrections"), _joined("loose").alias("loose"))


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_counts(audit.vault_audit(table(spark, d, "notes"), table(spark, d, "norms")))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = C.clean_evidence(table(spark, d, "evidence")).withColumn("tokens", X.estimate_tokens(F.coalesce("detail", F.lit(""))))
    return C.within_budget(rows, "concept_id", "ord", "tokens", BUDGET).select("concept_id", "ord", "tokens", "used")


def compile_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What a module of each concept's title holds: blocks, flagged ones, tokens."""
    notes = C.last_by_title(table(spark, d, "notes"), "content", "tags")
    hits = lexical.top_k(_scored(spark, d), 14)
    texts = cut(compile_plan.hit_texts(hits, notes))
    kept = compile_plan.blocks(texts, compile_plan.corrections(texts, table(spark, d, "norms")), 1200)
    return kept.groupBy("query").agg(F.count("*").alias("blocks"), F.count_if("flagged").alias("flagged"), F.max("used").alias("tokens"))


def thin_context(spark: SparkSession, d: str) -> DataFrame:
    """What a note tells of a case: its kind, day, source, extractor and title stand for the five keys."""
    m = F.create_map(F.lit(" Age"), F.col("kind"), F.lit("duration "), F.col("observed_on"), F.lit("MEDS"), F.col("source"), F.lit("workup"), F.col("extracted_by"), F.lit("goal"), F.col("title"))
    rows = table(spark, d, "notes").select("note_id", api.missing_context(m).alias("missing"))
    return rows.select("note_id", _joined("missing").alias("missing"), api.coverage(F.col("missing")).alias("coverage"))


def concept_strength(spark: SparkSession, d: str) -> DataFrame:
    return C.strength(C.clean_evidence(table(spark, d, "evidence")))


def compounding(spark: SparkSession, d: str) -> DataFrame:
    return C.compounding(C.strength(C.clean_evidence(table(spark, d, "evidence"))), table(spark, d, "concepts"))


def absorb_notes(spark: SparkSession, d: str) -> DataFrame:
    """Each concept after it has taken in, by note_id, all notes that evidence of the same source ties to it."""
    concepts = table(spark, d, "concepts")
    ties = C.clean_evidence(table(spark, d, "evidence")).select(F.col("concept_id").alias("id"), F.regexp_extract("source", r"^t-(\d+)$", 1).try_cast("long").alias("t"))
    notes = table(spark, d, "notes").select("note_id", F.col("source_transcript").try_cast("long").alias("t"), "title", "content", "tags", "links", "applies_norm")
    out = C.absorb(concepts, C.tied_notes(ties.filter("t IS NOT NULL"), notes.filter("t IS NOT NULL")))
    return out.select("id", "title", "content", *[_joined(c).alias(c) for c in ("tags", "aliases", "links", "applies_norm")])


def consolidate_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Notes that would take in one another, those of most members first; likeness is that of their rare terms."""
    index = _index(spark, d).select("title", "bag")
    pairs = graph.rare_token_links(index, "title", "bag").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("jaccard").alias("score"))
    members = table(spark, d, "notes").filter("title IS NOT NULL").groupBy("title").agg(F.count("*").alias("members"))
    order = members.select(F.col("title").alias("id"), F.struct((-F.col("members")).alias("m"), F.col("title").alias("t")).alias("place"))
    return C.greedy_absorption(pairs, order, 0.3)


def _batch(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A batch of notes ingested into the others: the stated queries of the vectors into the rest; a vector belongs to the note of its id."""
    vectors, notes = table(spark, d, "embeddings"), table(spark, d, "notes").filter("title IS NOT NULL")
    incoming = _queries_of(vectors)
    titled = notes.select("note_id", "title", "content", "tags", "links", "applies_norm", "source_transcript", "observed_on")
    stored = titled.join(vectors.filter("vec_id % 20 <> 0").select(F.col("vec_id").alias("note_id")), "note_id", "left_semi")
    concepts = stored.select(F.col("note_id").cast("string").alias("id"), "title", "content", "tags", F.array().cast("array<string>").alias("aliases"), "links", "applies_norm")
    items = titled.join(incoming.select(F.col("vec_id").alias("note_id")), "note_id", "left_semi").select(
        F.col("note_id").alias("item"), F.col("note_id").alias("place"), "title", "content", F.col("source_transcript").alias("source"), "observed_on", F.lit(None).cast("string").alias("detail"), "tags"
    )
    near = dense.nearest(vectors.filter("vec_id % 20 <> 0").join(stored.select(F.col("note_id").alias("vec_id")), "vec_id", "left_semi"), incoming, ingest.NEAR)
    batch = dense.nearest(incoming, incoming, incoming.count(), least=LINK_AT)
    in_batch = lambda df: df.join(items.select(F.col("item").alias("query")), "query", "left_semi")
    return ingest.ingest(
        concepts, items, in_batch(near).select(F.col("query").alias("item"), F.col("doc").cast("string").alias("target"), "score"),
        in_batch(batch).select(F.col("query").alias("item"), F.col("doc").alias("other"), "score"), "none", MERGE_AT, LINK_AT,
    )


def ingest_actions(spark: SparkSession, d: str) -> DataFrame:
    """What became of each note of the batch, in the order of their ids; later ones see what earlier ones created."""
    return _batch(spark, d)["decisions"].select("item", "action", "score")


def ingest_effects(spark: SparkSession, d: str) -> DataFrame:
    """The concepts that the batch changed or made, and their new rows of evidence."""
    out = _batch(spark, d)
    told = out["evidence"].groupBy("id").agg(F.count("*").alias("observations"))
    changed = out["concepts"].select("id", "title", *[_joined(c).alias(c) for c in ("tags", "aliases", "links")])
    return changed.join(told, "id", "left").select("id", "title", "tags", "aliases", "links", F.coalesce("observations", F.lit(0)).alias("observations"))


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").alias("upper_median"), F.count("*").alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, d, "events").select(k, "user_id", "value").groupBy("k").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


def checkpoint_anti(spark: SparkSession, d: str) -> DataFrame:
    """Encounters that no note was made of yet."""
    done = table(spark, d, "notes").select(F.col("source_transcript").try_cast("long").alias("id")).filter("id IS NOT NULL")
    return distill.open_records(table(spark, d, "transcriptions").select("id").distinct(), done)


def prepared(spark: SparkSession, d: str) -> DataFrame:
    rows = distill.prepare(table(spark, d, "transcriptions"), table(spark, d, "pii_patterns"))
    known = F.array_join(F.transform("pii_known", lambda k: F.concat(k["kind"], F.lit("="), k["value"])), "|")
    return rows.select("id", "date", F.length("transcript").alias("n_chars"), known.alias("known"))


def prepare_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcriptions").dropDuplicates(["id", "created_at", "transcription", "clinical_note"])
    usable = F.length(F.trim(F.coalesce("transcription", F.lit("")))) >= 120
    known = distill.known_pii(table(spark, d, "pii_patterns"))
    return rows.join(known, "id", "left").agg(
        F.count("*").alias("total"), F.count_if(usable).alias("usable"), F.count_if(usable & F.col("pii_known").isNotNull()).alias("with_known_pii"),
        F.count_if(usable & (F.trim(F.coalesce("clinical_note", F.lit(""))) != "")).alias("with_notes"),
    )


def pii_scrub(spark: SparkSession, d: str) -> DataFrame:
    rows = distill.prepare(table(spark, d, "transcriptions"), table(spark, d, "pii_patterns"))
    return rows.select("id", X.scrub(F.col("transcript"), F.col("pii_known")).alias("transcript"), X.scrub(F.col("notes"), F.col("pii_known")).alias("notes"))


def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each kind was scrubbed."""
    rows = pii_scrub(spark, d)
    marks = F.regexp_extract_all(F.concat_ws("\n", "transcript", "notes"), F.lit(r"\[REDACTED-([\w-]+)\]"), F.lit(1))
    return rows.select(F.explode(marks).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def source_page(spark: SparkSession, d: str) -> DataFrame:
    from notewright.sources.dumps import page, usable

    rows = table(spark, d, "transcriptions").select("id", "transcription").distinct()
    return page(usable(rows, "transcription"), "id", 5, 10).select("id", X.preview(F.col("transcription")).alias("preview"))


def copy_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the dump records with four tab-separated fields, unescaped."""
    from notewright.sources.dumps import encounters

    rows = table(spark, d, "raw_transcriptions").filter("layout = 'copy'").select(F.split(F.regexp_replace("raw", "\r$", ""), "\t").alias("fields"))
    return encounters(rows, list(rejects.COLUMNS), strict=True)


def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notes").select("note_id", X.slug(F.coalesce("title", F.lit("")), 80).alias("slug"))
    return C.unique_slugs(rows, "note_id", "slug", "note_id")


def tag_index(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "notes").select("note_id", F.explode("tags").alias("t")).select("note_id", F.lower(F.trim("t")).alias("tag")).filter("tag <> ''").distinct()
    return tags.groupBy("tag").agg(F.count("*").alias("notes"))


def tag_prefix_hits(spark: SparkSession, d: str) -> DataFrame:
    """Notes one of whose tags contains the last word of their title, without regard to case."""
    seed = F.lower(F.regexp_extract("title", r"([A-Za-z]+)[^A-Za-z]*$", 1))
    rows = table(spark, d, "notes").select("note_id", seed.alias("seed"), F.transform("tags", lambda t: F.lower(t)).alias("tags")).filter("seed <> ''")
    return rows.filter(F.exists("tags", lambda t: t.contains(F.col("seed")))).select("note_id", "seed")


def note_markdown(spark: SparkSession, d: str) -> DataFrame:
    return markdown.note_markdown(table(spark, d, "notes"))


def note_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Notes as read back from their Markdown."""
    rows = markdown.parse_notes(markdown.note_markdown(table(spark, d, "notes")))
    return rows.select("file_name", "title", "kind", "content", _joined("links").alias("links"), "source")


def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    return markdown.evidence_lines(C.clean_evidence(table(spark, d, "evidence")))


def evidence_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return markdown.parse_evidence(markdown.evidence_lines(C.clean_evidence(table(spark, d, "evidence"))))


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    """Texts by digest: how many documents hold each, and the first of them."""
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


_QUERIES = (
    p4_found, p4_rows, tokenize_df, bm25_topk, rrf_fuse, hybrid_search, search_expand, search_in_order, dense_topk, knn_edges, ingest_bands, graph_stats, hubs, link_histogram,
    neighbours_d2, rare_token_links, weighted_graph, graph_kinds, activation, link_exact, link_jaccard, link_resolution, retriever_stats, exact_merge, value_spans, note_validate,
    norm_names, norm_lookup, norm_stale, norm_search, norm_audit, document_audit, name_audit, vault_audit, audit_counts, context_budget, compile_blocks, thin_context, concept_strength,
    compounding, absorb_notes, consolidate_greedy, ingest_actions, ingest_effects, upper_median, json_props, checkpoint_anti, prepared, prepare_stats, pii_scrub, pii_counts, source_page, copy_fields,
    unique_slugs, tag_index, tag_prefix_hits, note_markdown, note_round_trip, evidence_lines, evidence_round_trip, content_digest,
)


def oracle_sql() -> dict[str, str]:
    from notewright.oracle import SQL

    return dict(SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def entry(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d)
