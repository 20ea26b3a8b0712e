"""Compiling a module: the hits of a query with corrections, values and freshness, under a token budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from notewright.functions.text import estimate_tokens, value_spans
from notewright.operators import norms as N
from notewright.operators.concepts import within_budget

DEFAULT_TOKENS = 8000


def hit_texts(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """(query, doc, rank, score, text, content, tags): hits with their notes' texts."""
    picked = notes.select(F.col("title").alias("doc"), "content", "tags")
    text = F.concat(F.col("doc"), F.lit("\n"), F.coalesce("content", F.lit("")))
    return hits.join(picked, "doc").select("query", "doc", "rank", "score", text.alias("text"), F.coalesce("content", F.lit("")).alias("content"), "tags")


def corrections(texts: DataFrame, norms: DataFrame) -> DataFrame:
    """(query, found, norm_id, superseded_by, migration, authority, first_rank): retired names by their first hit."""
    keyed = texts.withColumn("key", F.struct("query", "rank"))
    found = N.audit(keyed, "key", "text", norms)
    return found.groupBy(F.col("key.query").alias("query"), "found").agg(
        F.min("key.rank").alias("first_rank"), F.first("norm_id").alias("norm_id"), F.first("superseded_by").alias("superseded_by"), F.first("migration").alias("migration"), F.first("authority").alias("authority")
    )


def blocks(texts: DataFrame, found: DataFrame, budget: int = DEFAULT_TOKENS, head: int = 0) -> DataFrame:
    """(query, rank, doc, flagged, tokens, used): the blocks that fit the budget.

    A block is flagged if it contains a retired name that this or an earlier hit brought up, as a
    substring without regard to case.
    """
    flags = texts.join(found.select("query", "found", "first_rank"), "query").filter((F.col("first_rank") <= F.col("rank")) & F.lower("text").contains(F.col("found")))
    flags = flags.select("query", "rank", F.lit(True).alias("flagged")).distinct()
    body = F.concat(
        F.lit("### "), F.col("doc"), F.lit("   [relevance "), F.format_string("%.2f", "score"), F.lit("]\nTags: "),
        F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)), " "), F.lit("\n"), F.col("content"), F.lit("\n"),
    )
    rows = texts.join(flags, ["query", "rank"], "left").select("query", "rank", "doc", F.coalesce("flagged", F.lit(False)).alias("flagged"), body.alias("block"))
    rows = rows.withColumn("tokens", estimate_tokens(F.col("block")))
    return within_budget(rows, "query", "rank", "tokens", budget or DEFAULT_TOKENS, head)


def values(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(query, value, norm_id): values that the hits state, with the norm that has that name, if any."""
    spans = texts.select("query", F.explode(value_spans(F.col("content"))).alias("value")).distinct()
    return N.resolve(spans, "value", names).select("query", "value", "norm_id")


@dataclass
class Compiled:
    """One module; its lists are as long as a query has hits, not as the corpus."""

    query: str
    prompt: str
    concepts: list[tuple[str, float]]
    corrections: list[dict]
    norm_refs: list[str]
    unverified_values: list[str]
    stale_norms: list[str]
    estimated_tokens: int
    extra: dict = field(default_factory=dict)


def compile_module(query: str, hits: DataFrame, notes: DataFrame, norms: DataFrame, today: str, max_tokens: int = 0) -> Compiled:
    """The prompt of one query: corrections, freshness, norms and values first, then the notes that fit.

    ``hits`` are at most k rows; only they and their annotations come to the driver.
    """
    texts = hit_texts(hits, notes)
    found = corrections(texts, norms)
    fixes = [r.asDict() for r in found.orderBy("first_rank", "found").collect()]
    stated = values(texts, N.norm_names(norms)).collect()
    stale = [r["id"] for r in N.stale(norms, today).orderBy("id").collect()]
    refs = sorted({f["norm_id"] for f in fixes} | {r["norm_id"] for r in stated if r["norm_id"]})
    listed = sorted({r["value"] for r in stated})
    head = [f"# Clinical reasoning module: {query}", ""]
    if fixes:
        head += ["## Superseded parameters", *[f"- {f['found']} -> {f['superseded_by']} ({f['authority']}): {f['migration'] or ''}" for f in fixes], ""]
    if stale:
        head += [f"> {len(stale)} norm records are due for verification: " + ", ".join(stale), ""]
    if refs:
        head += ["## Norms referred to", *[f"- {r}" for r in refs], ""]
    if listed:
        head += ["## Values to verify before use", ", ".join(listed), ""]
    text = "\n".join([*head, "---", ""])
    kept = blocks(texts, found, max_tokens, len(text) // 4).orderBy("rank").collect()
    used = kept[-1]["used"] if kept else len(text) // 4
    order = {r["doc"]: r["score"] for r in hits.orderBy("rank").collect()}
    end = f"\n---\n# End | {len(kept)} notes | about {used} tokens | {len(fixes)} corrections\n"
    return Compiled(query, text + "\n".join(r["block"] for r in kept) + end, [(r["doc"], order[r["doc"]]) for r in kept], fixes, refs, listed, stale, int(used))
