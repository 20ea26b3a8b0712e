"""Notes and concepts as Markdown text, written and read with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from notewright.functions.text import slug


def _list(items: Column, mark: str = "") -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x)), ", "), F.lit("]"))


def note_markdown(notes: DataFrame) -> DataFrame:
    """(file_name, value): one Markdown text per note; null fields are left empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.concat(
        F.lit("---\ntitle: "), text("title"), F.lit("\nkind: "), text("kind"), F.lit("\ntags: "), _list(F.col("tags"), "#"),
        F.lit("\napplies_norm: "), _list(F.col("applies_norm")), F.lit("\nsource_transcript: "), text("source_transcript"),
        F.lit("\nobserved_on: "), text("observed_on"), F.lit("\nsource: "), text("source"), F.lit("\n---\n\nContent: "), text("content"),
        F.lit("\nLinks: "), F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " "), F.lit("\n"),
    )
    return notes.select("file_name", body.alias("value"))


def parse_notes(texts: DataFrame, file: str = "file_name", value: str = "value") -> DataFrame:
    """(file_name, title, kind, content, tags, links, source) of each text; those without a title are left out."""
    part = lambda p, n=1: F.regexp_extract(value, p, n)
    content = F.when(F.col(value).contains("Content:"), part(r"(?s)Content:(.*?)(?:\nLinks:|$)(?!.*\nLinks:)")).otherwise(F.col(value))
    rows = texts.select(
        F.col(file).alias("file_name"), F.trim(part(r"(?m)^title:[ \t]*(.+)$")).alias("title"),
        F.coalesce(F.nullif(part(r"(?m)^kind:[ \t]*(\w+)"), F.lit("")), F.lit("pattern")).alias("kind"),
        F.regexp_replace(content, r"^\s+|\s+$", "").alias("content"),
        F.regexp_extract_all(value, F.lit(r"#([\w-]+)"), F.lit(1)).alias("tags"),
        F.regexp_extract_all(value, F.lit(r"\[\[(.+?)\]\]"), F.lit(1)).alias("links"),
        F.nullif(F.trim(part(r"(?m)^source:[ \t]*(.*)$")), F.lit("")).alias("source"),
    )
    return rows.filter("title <> ''")


def file_name() -> Column:
    """The name of a row's file, as it is written in the folder."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a folder of Markdown files; a file is a row, and files with one title leave the last by name."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", file_name().alias("file_name"))
    rows = parse_notes(files)
    return rows.groupBy("title").agg(F.max_by(F.struct("file_name", "kind", "content", "tags", "links", "source"), "file_name").alias("n")).select("title", "n.*")


def write_notes(notes: DataFrame, folder: str) -> None:
    """One text file of blocks per partition, each block after a line with its file name; Parquet stays the store."""
    made = note_markdown(notes)
    made.select(F.concat(F.lit("<!-- "), "file_name", F.lit(" -->\n"), "value").alias("value")).write.mode("errorifexists").text(folder)


def file_names(notes: DataFrame) -> DataFrame:
    """(note_id, file_name): day, id and a slug of the title of at most 40 characters."""
    name = F.concat_ws("-", F.coalesce("observed_on", F.lit("undated")), F.col("note_id").cast("string"), slug(F.coalesce("title", F.lit("")), 40))
    return notes.select("note_id", F.concat(name, F.lit(".md")).alias("file_name"))


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """(concept_id, ord, line): ``- [[source]] day — ⚠ CONTRADICTS — detail``."""
    day = F.coalesce(F.concat(F.lit(" "), F.nullif(F.trim("observed_on"), F.lit(""))), F.lit(""))
    flag = F.when(F.coalesce("contradicts", F.lit(False)), F.lit(" — ⚠ CONTRADICTS")).otherwise(F.lit(""))
    line = F.concat(F.lit("- [["), F.coalesce("source", F.lit("")), F.lit("]]"), day, flag, F.lit(" — "), F.coalesce("detail", F.lit("")))
    return evidence.select("concept_id", "ord", line.alias("line"))


def parse_evidence(lines: DataFrame) -> DataFrame:
    """(concept_id, ord, source, observed_on, contradicts, detail) of evidence lines."""
    p = r"(?s)^- \[\[(.*?)\]\](?: (\d{4}-\d{2}-\d{2}))?(?: [^—]*?)?( — ⚠ CONTRADICTS)? — (.*)$"
    part = lambda n: F.regexp_extract("line", p, n)
    rows = lines.filter(F.col("line").rlike(p))
    return rows.select("concept_id", "ord", part(1).alias("source"), F.nullif(part(2), F.lit("")).alias("observed_on"), (part(3) != "").alias("contradicts"), part(4).alias("detail"))
