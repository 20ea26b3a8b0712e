"""The audit of a whole vault: retired names and values that no norm covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from notewright.functions.text import value_spans
from notewright.operators import norms as N
from notewright.operators.concepts import last_by_title


def vault_audit(notes: DataFrame, norms: DataFrame) -> DataFrame:
    """(title, corrections, loose): sorted retired names and sorted uncovered values of each note; both may be empty."""
    last = last_by_title(notes, "content")
    text = F.concat(F.col("title"), F.lit("\n"), F.coalesce("content", F.lit("")))
    found = N.audit(last.select("title", text.alias("text")), "title", "text", norms).groupBy("title").agg(F.array_sort(F.collect_set("found")).alias("corrections"))
    claims = last.select("title", F.explode(value_spans(F.coalesce("content", F.lit("")))).alias("value"))
    loose = N.resolve(claims, "value", N.norm_names(norms)).filter("norm_id IS NULL").groupBy("title").agg(F.array_sort(F.collect_set("value")).alias("loose"))
    none = F.array().cast("array<string>")
    return last.select("title").join(found, "title", "left").join(loose, "title", "left").select("title", F.coalesce("corrections", none).alias("corrections"), F.coalesce("loose", none).alias("loose"))


def audit_counts(audited: DataFrame) -> DataFrame:
    c, u = F.size("corrections") > 0, F.size("loose") > 0
    return audited.agg(F.count("*").alias("notes"), F.count_if(~c & ~u).alias("clean"), F.count_if(c).alias("retired"), F.count_if(u).alias("unmapped"))


def report(audited: DataFrame, longest: int = 50) -> str:
    """A short Markdown report: the counts and the first titles of each list."""
    n = audit_counts(audited).first()
    lines = [f"# Audit of {n['notes']} notes", f"- clean: {n['clean']}", f"- with retired parameters: {n['retired']}", f"- with values no norm covers: {n['unmapped']}", ""]
    for r in audited.filter(F.size("corrections") > 0).orderBy("title").limit(longest).collect():
        lines.append(f"- {r['title']}: {', '.join(r['corrections'])}")
    return "\n".join(lines)
