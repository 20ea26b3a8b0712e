"""Hybrid retrieval: lexical and dense rankings, fused, normalised and expanded over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from notewright.functions.text import weighted_bag
from notewright.operators import graph, lexical
from notewright.operators.concepts import last_by_title
from notewright.session import cut

#: Fixed value: share of a hit's score that its links get.
SPREAD = 0.45


def note_index(notes: DataFrame, *keep: str) -> DataFrame:
    """(title, tags, content, bag and the fields to keep): one note per title with its weighted terms."""
    last = last_by_title(notes, "tags", "content", *keep)
    return last.withColumn("bag", weighted_bag(F.col("title"), F.col("tags"), F.col("content")))


def note_links(notes: DataFrame, only_exact: bool = False) -> DataFrame:
    """(src, dst): resolved links between titles."""
    links = notes.select(F.col("title").alias("src"), F.explode("links").alias("link"))
    resolved = graph.exact_links(links, notes) if only_exact else graph.resolve_links(links, notes)
    return links.join(resolved.select("link", F.col("title").alias("dst")), "link").select("src", "dst").filter("src <> dst").distinct()


def expand_once(scored: DataFrame, edges: DataFrame, k: int, decay: float = SPREAD) -> DataFrame:
    """(query, doc, score, rank): the top k and what they are linked to at ``decay`` times their score, the best k of both."""
    seeds = lexical.top_k(scored, k)
    reached = seeds.join(edges, seeds["doc"] == edges["src"]).select("query", F.col("dst").alias("doc"), F.round(F.col("score") * decay, 6).alias("score"))
    both = scored.select("query", "doc", "score").unionByName(reached).groupBy("query", "doc").agg(F.max("score").alias("score"))
    return lexical.top_k(both, k)


def _relax(scores: dict[str, float], seeds: list[str], links: dict[str, list[str]], hops: int, decay: float) -> dict[str, float]:
    """Seeds in order raise their neighbours, also other seeds, whose raised scores then spread."""
    out = dict(scores)
    for depth in range(1, hops + 1):
        for s in seeds:
            for n in links.get(s, []):
                out[n] = max(out.get(n, 0.0), round(out[s] * decay**depth, 6))
    return out


def expand_in_order(scored: DataFrame, edges: DataFrame, k: int, hops: int = 1, decay: float = SPREAD) -> DataFrame:
    """As ``expand_once``, but seeds act one after the other in place: per query at most k seeds and their links."""
    seeds = lexical.top_k(scored, k)
    links = seeds.join(edges, seeds["doc"] == edges["src"]).groupBy("query", F.col("doc").alias("seed")).agg(F.array_sort(F.collect_set("dst")).alias("to"))
    ends = links.select("query", F.explode("to").alias("doc"))
    known = scored.join(ends.unionByName(seeds.select("query", "doc")).distinct(), ["query", "doc"])
    per = known.groupBy("query").agg(F.collect_list(F.struct("doc", "score")).alias("scores"))
    per = per.join(seeds.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("seeds")), "query")
    per = per.join(links.groupBy("query").agg(F.collect_list(F.struct("seed", "to")).alias("links")), "query", "left")

    def run(frames):
        import pandas as pd

        for df in frames:
            rows = []
            for q, scores, order, held in zip(df["query"], df["scores"], df["seeds"], df["links"]):
                got = _relax({x["doc"]: x["score"] for x in scores}, list(order), {x["seed"]: list(x["to"]) for x in (held if held is not None else [])}, hops, decay)
                rows += [(q, doc, s) for doc, s in got.items()]
            yield pd.DataFrame(rows, columns=["query", "doc", "score"])

    raised = per.select("query", "scores", "seeds", "links").mapInPandas(run, "query string, doc string, score double")
    both = scored.select(F.col("query").cast("string").alias("query"), "doc", "score").unionByName(raised).groupBy("query", "doc").agg(F.max("score").alias("score"))
    return lexical.top_k(both, k)


def search(notes: DataFrame, queries: DataFrame, query_key: str, query_text: str, k: int = 12, dense: DataFrame | None = None, edges: DataFrame | None = None, in_order: bool = True) -> DataFrame:
    """(query, doc, score, rank): the best k notes of each query.

    ``dense`` is an optional (query, doc, rank) ranking of an encoder over all notes; without it the
    lexical scores stand alone. Every scored note is ranked in both before they are fused. ``edges`` may be given, else the notes' resolved links are used.
    """
    index = cut(note_index(notes, "links"))
    scored = lexical.bm25(index, "title", "bag", queries, query_key, query_text)
    if dense is not None:
        scored = lexical.fuse(lexical.ranks(scored), dense)
    scored = cut(lexical.normalised(scored))
    edges = edges if edges is not None else graph.adjacency(note_links(index))
    edges = cut(edges)
    return expand_in_order(scored, edges, k) if in_order else expand_once(scored, edges, k)
