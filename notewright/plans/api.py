"""The serving functions: each returns a DataFrame or a small dict ready for JSON."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from notewright.functions.text import preview
from notewright.operators import concepts as C, dense, graph, norms as N
from notewright.plans import audit, compile as compile_plan, retrieve
from notewright.session import table
from notewright.sources import dumps

#: What a case must tell, in the order in which it is asked for.
CONTEXT_KEYS = ("age", "duration", "meds", "workup", "goal")


def missing_context(context: Column) -> Column:
    """Keys of a case (a map) that are absent or empty; names of keys without regard to case and blanks."""
    known = F.map_keys(F.map_filter(context, lambda k, v: v.isNotNull() & (v != "")))
    clean = F.transform(known, lambda k: F.lower(F.trim(k)))
    return F.array_except(F.array(*[F.lit(k) for k in CONTEXT_KEYS]), F.coalesce(clean, F.array().cast("array<string>")))


def coverage(missing: Column) -> Column:
    return F.round((len(CONTEXT_KEYS) - F.size(missing)) / len(CONTEXT_KEYS), 2)


class Knowledge:
    """The tables of one vault and the questions they answer."""

    def __init__(self, spark: SparkSession, folder: str, today: str):
        self.spark, self.today = spark, today
        self.notes, self.norms, self.concepts, self.evidence = (table(spark, folder, t) for t in ("notes", "norms", "concepts", "evidence"))

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(query, query)], "q string, text string")

    def session_brief(self, context: dict[str, str]) -> dict:
        known = {k.strip().lower() for k, v in (context or {}).items() if v not in (None, "", [], {})}
        missing = [k for k in CONTEXT_KEYS if k not in known]
        return {"missing": missing, "coverage": (len(CONTEXT_KEYS) - len(missing)) / len(CONTEXT_KEYS)}

    def search(self, query: str, k: int = 10) -> DataFrame:
        hits = retrieve.search(self.notes, self._asked(query), "q", "text", k)
        return hits.join(C.last_by_title(self.notes).select(F.col("title").alias("doc"), preview(F.col("content")).alias("preview")), "doc")

    def get_note(self, title: str) -> DataFrame:
        note = C.last_by_title(self.notes.filter(F.col("title") == title))
        found = N.audit(note, "title", "content", self.norms).groupBy("title").agg(F.collect_set("found").alias("corrections"))
        return note.join(found, "title", "left")

    def neighbours(self, title: str, depth: int = 1) -> DataFrame:
        edges = graph.adjacency(retrieve.note_links(C.last_by_title(self.notes)))
        return graph.neighbours(edges, self.spark.createDataFrame([(title,)], "node string"), depth).select("node").orderBy("node")

    def compile(self, query: str, max_tokens: int = 0, k: int = 14, context: dict[str, str] | None = None) -> compile_plan.Compiled:
        hits = retrieve.search(self.notes, self._asked(query), "q", "text", k)
        out = compile_plan.compile_module(query, hits, C.last_by_title(self.notes), self.norms, self.today, max_tokens)
        out.extra["ask_next"] = self.session_brief(context or {})["missing"]
        return out

    def graph_stats(self) -> DataFrame:
        last = C.last_by_title(self.notes)
        edges = graph.adjacency(retrieve.note_links(last))
        return graph.graph_stats(edges, last.select(F.col("title").alias("node")))

    def norm_lookup(self, name: str) -> DataFrame:
        found = N.lookup(self.spark.createDataFrame([(name,)], "asked string"), "asked", self.norms)
        return found.join(N.with_expiry(self.norms).withColumnRenamed("id", "norm_id"), "norm_id", "left")

    def norm_search(self, query: str, limit: int = 5) -> DataFrame:
        return N.search(self.norms, self.spark.createDataFrame([(query,)], "query string"), limit=limit)

    def stale_norms(self) -> DataFrame:
        return N.stale(self.norms, self.today)

    def audit(self) -> DataFrame:
        return audit.vault_audit(self.notes, self.norms)

    def concept_candidates(self, vectors: DataFrame, item: DataFrame, k: int = 5) -> DataFrame:
        return dense.nearest(vectors, item, k)

    def concept_ingest(self, vectors: DataFrame, incoming: DataFrame, mode: str = "harness") -> DataFrame:
        return C.decide(dense.nearest(vectors, incoming, 1).filter("rank = 1"), mode)

    def concept_merge(self, base: str, other: str) -> tuple[DataFrame, DataFrame]:
        """The kept concept and its evidence after it has taken in the other; none if either is missing or both are one."""
        second = self.concepts.filter((F.col("id") == other) & (F.col("id") != base)).withColumn("id", F.lit(base))
        merged = C.absorb(self.concepts.filter(F.col("id") == base), second)
        pair = merged.select(F.lit(other).alias("id"), F.col("id").alias("into"))
        told = C.clean_evidence(self.evidence).filter(F.col("concept_id").isin(base, other))
        return merged, C.absorb_evidence(told, pair).filter(F.col("concept_id") == base)

    def concept_compounding(self) -> DataFrame:
        return C.compounding(C.strength(C.clean_evidence(self.evidence)), self.concepts)

    def source_discover(self, folder: str) -> list[dict]:
        return dumps.sources(self.spark, folder)

    def source_read(self, folder: str, file: str = "", limit: int = 5, offset: int = 0) -> DataFrame:
        """A page of encounters of the first source, or of the one whose file name or path is ``file``; none: an error."""
        found = [s for s in dumps.sources(self.spark, folder) if not file or file in (s["path"], os.path.basename(s["path"]))]
        if not found:
            raise ValueError(f"no usable source in {folder}")
        return dumps.page(dumps.usable(dumps.read_source(self.spark, found[0])), "id", limit, offset)

    def titles_with(self, text: str) -> DataFrame:
        """Titles that contain a text, without regard to letter case."""
        return C.last_by_title(self.notes, "file_name").select("title").filter(F.lower("title").contains(text.lower()))
