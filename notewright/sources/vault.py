"""Files of a vault: strict flat notes, concepts with their evidence, norms, and consolidated snapshots."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from notewright.operators.concepts import _empty, strength
from notewright.session import cut
from notewright.sources.markdown import evidence_lines, file_name, parse_evidence

try:
    import yaml
except ImportError:  # files with YAML heads cannot be read then
    yaml = None

_HEAD = r"(?s)^---\n(.*?)\n---\n(.*)$"


def parse_flat(texts: DataFrame, file: str = "file_name", value: str = "value") -> DataFrame:
    """(file_name, title, kind, source, tags, applies_norm, observed_on, extracted_by, content, links): notes with a head of ``key: value`` lines.

    Texts without such a head or without a title are left out; notes of one title all stay.
    """
    head, body = F.regexp_extract(value, _HEAD, 1), F.regexp_extract(value, _HEAD, 2)
    rows = texts.filter(F.col(value).rlike(_HEAD)).select(F.col(file).alias("file_name"), head.alias("head"), body.alias("body"))
    # of lines with one key the last counts
    key = lambda k: F.trim(F.regexp_extract("head", rf"(?s)^(?:.*\n)?[ \t]*{k}[ \t]*:([^\n]*)", 1))
    given = lambda k, other: F.when(F.col("head").rlike(rf"(?m)^[ \t]*{k}[ \t]*:"), key(k)).otherwise(F.lit(other))
    items = F.filter(F.transform(F.split(F.regexp_replace(given("applies_norm", "[]"), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    content = F.regexp_extract("body", r"(?s)Content:(.*?)(?=\nLinks:|\z)", 1)
    out = rows.select(
        "file_name", given("title", "").alias("title"), given("kind", "pattern").alias("kind"), given("source", "unknown").alias("source"),
        F.regexp_extract_all(given("tags", "[]"), F.lit(r"#([^\s,\]]+)"), F.lit(1)).alias("tags"), items.alias("applies_norm"), given("observed_on", "").alias("observed_on"),
        given("extracted_by", "").alias("extracted_by"), F.regexp_replace(content, r"^\s+|\s+$", "").alias("content"),
        F.regexp_extract_all("body", F.lit(r"(?m)^- \[\[(.+?)\]\]\s*$"), F.lit(1)).alias("links"),
    )
    return out.filter("title <> ''")


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select("value", file_name().alias("file_name"))


def read_flat(spark: SparkSession, folder: str) -> DataFrame:
    """The flat notes of a folder of Markdown files."""
    return parse_flat(_files(spark, folder, "*.md"))


def _quoted(text: Column) -> Column:
    """A text as a quoted scalar."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def concept_markdown(concepts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, value): one Markdown text per concept: head, content, evidence in order, links; empty parts are left out."""
    told = strength(evidence).withColumnRenamed("concept_id", "id")
    lines = evidence_lines(evidence).groupBy(F.col("concept_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    rows = concepts.join(told, "id", "left").join(lines, "id", "left")
    line = lambda name, value, when: F.when(when, F.concat(F.lit(f"\n{name}: "), value)).otherwise("")
    listed = lambda c: line(c, F.to_json(_empty(c)), F.size(_empty(c)) > 0)
    dated = lambda c: line(c, _quoted(F.col(c)), F.col(c).isNotNull())
    s, against = F.coalesce("strength", F.lit(0)), F.coalesce("contradicting", F.lit(0))
    head = F.concat(
        F.lit("---\nid: "), _quoted(F.col("id")), F.lit("\ntitle: "), _quoted(F.coalesce("title", F.lit(""))), F.lit("\nkind: "), _quoted(F.coalesce("kind", F.lit("pattern"))),
        F.lit("\nstrength: "), s.cast("string"), F.lit("\ntags: "), F.to_json(_empty("tags")), listed("aliases"), listed("applies_norm"), dated("first_seen"), dated("last_seen"),
        line("contested", against.cast("string"), against > 0), F.lit("\n---\n\n"),
    )
    shown = F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n## Evidence ("), s.cast("string"), F.lit(")\n\n"), "lines", F.lit("\n"))).otherwise("")
    links = F.when(F.size(_empty("links")) > 0, F.concat(F.lit("\n## Links\n\n"), F.array_join(F.transform(_empty("links"), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", "), F.lit("\n"))).otherwise("")
    return rows.select("id", F.concat(head, F.trim(F.coalesce("content", F.lit(""))), F.lit("\n"), shown, links).alias("value"))


def _texts(x: object) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else []


def _head_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for stem, head in zip(df["stem"], df["head"]):
            try:
                fm = yaml.safe_load(head) or {}
            except yaml.YAMLError:
                fm = {}
            fm = fm if isinstance(fm, dict) else {}
            title = str(fm.get("title") or stem)
            rows.append((stem, None if fm.get("id") is None else str(fm["id"]), title, str(fm.get("kind", "pattern")), _texts(fm.get("tags")), _texts(fm.get("aliases")), _texts(fm.get("applies_norm"))))
        yield pd.DataFrame(rows, columns=["stem", "given_id", "title", "kind", "tags", "aliases", "applies_norm"])


def parse_concepts(texts: DataFrame, file: str = "file_name", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(concepts, evidence) of concept texts; a head that is no YAML counts as empty, other sections than evidence and links are left out."""
    from notewright.functions.text import slug

    rows = texts.select(F.regexp_replace(file, r"\.md$", "").alias("stem"), F.regexp_extract(value, _HEAD, 1).alias("head"), F.when(F.col(value).rlike(_HEAD), F.regexp_extract(value, _HEAD, 2)).otherwise(F.col(value)).alias("body"))
    heads = rows.select("stem", "head").mapInPandas(_head_batches, "stem string, given_id string, title string, kind string, tags array<string>, aliases array<string>, applies_norm array<string>")
    parts = rows.select("stem", F.split("body", r"(?m)^##\s+").alias("parts"))
    section = lambda name: F.array_join(F.filter(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: F.lower(p).startswith(name)), "\n")
    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    said = parts.select("stem", clean(F.col("parts")[0]).alias("content"), section("evidence").alias("told"), F.regexp_extract_all(section("link"), F.lit(r"\[\[(.+?)\]\]"), F.lit(1)).alias("links"))
    both = cut(heads.join(said, "stem"))
    name = F.coalesce(F.nullif("given_id", F.lit("")), F.nullif(slug(F.col("title")), F.lit("")), F.col("stem"))
    concepts = both.select(name.alias("id"), "title", "kind", "content", "tags", "aliases", "links", "applies_norm")
    lines = both.select(name.alias("concept_id"), F.posexplode(F.split("told", "\n")).alias("ord", "line"))
    return concepts, parse_evidence(lines)


def write_concepts(concepts: DataFrame, evidence: DataFrame, folder: str) -> None:
    """A new snapshot of a vault's concepts: Markdown blocks, each after a line with its file name; nothing is overwritten or deleted."""
    made = concept_markdown(concepts, evidence)
    made.select(F.concat(F.lit("<!-- "), "id", F.lit(".md -->\n"), "value").alias("value")).write.mode("errorifexists").text(folder)


def read_concepts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, evidence) of a folder of Markdown files or of a snapshot of blocks."""
    whole = _files(spark, folder, "*")
    block = F.explode(F.filter(F.split("value", r"(?m)^(?=<!-- [^\n]*\.md -->$)"), lambda b: b != ""))
    blocks = whole.filter(F.col("value").startswith("<!-- ")).select(block.alias("b")).select(F.regexp_extract("b", r"^<!-- ([^\n]*) -->\n", 1).alias("file_name"), F.regexp_replace("b", r"^<!-- [^\n]* -->\n", "").alias("value"))
    files = whole.filter(~F.col("value").startswith("<!-- ") & F.col("file_name").endswith(".md")).select("file_name", "value")
    return parse_concepts(files.unionByName(blocks))


def as_date(value: object) -> date | None:
    """A day of a date, a time or an ISO text; anything else is none."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    try:
        return date.fromisoformat(str(value).strip()[:10])
    except ValueError:
        return None


NORM = "id string, current string, authority string, valid_from date, last_verified date, volatility string, thresholds map<string,string>, supersedes array<struct<name:string,until:date,authority:string,migration:string>>, notes string, aliases array<string>, ord int"


def read_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Norm records of a folder of YAML files, ordered by file name; a record without an id is an error, other keys have defaults."""
    files = _files(spark, folder, "*.y*ml")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for name, text in zip(df["file_name"], df["value"]):
                x = yaml.safe_load(text) or {}
                earlier = [{"name": s.get("name"), "until": as_date(s.get("until")), "authority": s.get("authority"), "migration": s.get("migration")} for s in x.get("supersedes") or []]
                limits = {str(k): str(v) for k, v in (x.get("thresholds") or {}).items()}
                rows.append((name, x["id"], x.get("current", ""), x.get("authority", ""), as_date(x.get("valid_from")), as_date(x.get("last_verified")), str(x.get("volatility", "12mo")), limits, earlier, x.get("notes") or "", _texts(x.get("aliases"))))
            yield pd.DataFrame(rows, columns=["file_name", *[f.split(" ")[0] for f in NORM.split(", ")[:-1]]])

    rows = cut(files.mapInPandas(run, "file_name string, " + NORM.rsplit(", ", 1)[0]))
    order = rows.select("file_name").distinct().orderBy("file_name").limit(100_001).collect()  # a dimension: one row a file
    if len(order) > 100_000:
        raise ValueError("more than 100,000 norm files")
    places = spark.createDataFrame([(r["file_name"], n) for n, r in enumerate(order)], "file_name string, ord int")
    return rows.join(F.broadcast(places), "file_name").drop("file_name")


def write_consolidated(merged: DataFrame, members: DataFrame, links: DataFrame, folder: str) -> None:
    """A new snapshot of merged notes with their links, and a manifest (title, file_name, merged_from, links) as JSON lines.

    ``merged`` comes from ``merge_titles``, ``members`` has title and file_name, ``links`` src and dst. The source files stay.
    """
    tied = links.groupBy(F.col("src").alias("title")).agg(F.array_sort(F.collect_set("dst")).alias("links"))
    none = F.array().cast("array<string>")
    out = cut(merged.join(tied, "title", "left").withColumn("links", F.coalesce("links", none)))
    out.write.mode("errorifexists").parquet(os.path.join(folder, "notes"))
    files = members.filter("title IS NOT NULL").groupBy("title").agg(F.array_sort(F.collect_set("file_name")).alias("files"))
    listed = out.select("title", F.size("links").alias("links")).join(files, "title", "left")
    listed.select("title", F.get("files", F.lit(0)).alias("file_name"), F.slice("files", 2, F.greatest(F.size("files") - 1, F.lit(0))).alias("merged_from"), "links").write.mode("errorifexists").json(os.path.join(folder, "manifest"))
