"""Batch distillation: scrub, gate, model call, validation, quarantine; the model is an injected callable."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from notewright.functions.text import clean_tags, scrub, validation_errors
from notewright.session import cut
from notewright.sources import dumps

NOTE = "record string, n int, title string, kind string, content string, tags array<string>, applies_norm array<string>, error string"


def known_pii(patterns: DataFrame) -> DataFrame:
    """(id, pii_known): known values of each encounter; null ids and values under three characters go."""
    rows = patterns.filter(F.col("transcription_id").isNotNull() & (F.length(F.trim("pattern")) >= 3))
    pair = F.struct(F.lower(F.trim("pii_type")).alias("kind"), F.trim("pattern").alias("value"))
    return rows.groupBy(F.col("transcription_id").alias("id")).agg(F.array_sort(F.collect_set(pair)).alias("pii_known"))


def prepare(transcriptions: DataFrame, patterns: DataFrame, least: int = 120) -> DataFrame:
    """(id, transcript, notes, date, pii_known): usable encounters with what is known about them."""
    rows = transcriptions.dropDuplicates(["id", "created_at", "transcription", "clinical_note"])
    rows = rows.filter(F.length(F.trim(F.coalesce("transcription", F.lit("")))) >= least)
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return rows.join(known_pii(patterns), "id", "left").select(
        "id", F.col("transcription").alias("transcript"), F.coalesce("clinical_note", F.lit("")).alias("notes"), F.date_format("created_at", "yyyy-MM-dd").alias("date"), F.coalesce("pii_known", none).alias("pii_known")
    )


def open_records(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records that no earlier run finished."""
    return records.join(done.select("id").distinct(), "id", "left_anti")


def distil(records: DataFrame, model: Callable[[str, str], list[dict]], least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(valid notes, quarantined notes) of the records; ``model`` gets scrubbed transcript and notes.

    A record is skipped if both texts are shorter than ``least`` after scrubbing. A failing call is one
    quarantined row with the error, never a failed job.
    """
    clean = records.select(F.col("id").cast("string").alias("record"), scrub(F.col("transcript"), F.col("pii_known")).alias("transcript"), scrub(F.col("notes"), F.col("pii_known")).alias("notes"))
    clean = clean.filter((F.length("transcript") >= least) | (F.length("notes") >= least))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for record, transcript, notes in zip(df["record"], df["transcript"], df["notes"]):
                try:
                    made = model(transcript, notes)
                    rows += [(record, n, m.get("title"), m.get("kind"), m.get("content"), m.get("tags") or [], m.get("applies_norm") or [], None) for n, m in enumerate(made)]
                except Exception as e:  # noqa: BLE001
                    rows.append((record, 0, None, None, None, [], [], str(e)[:400]))
            yield pd.DataFrame(rows, columns=["record", "n", "title", "kind", "content", "tags", "applies_norm", "error"])

    made = clean.mapInPandas(call, NOTE).withColumn("tags", clean_tags(F.col("tags")))
    errors = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(validation_errors(F.col("title"), F.col("kind"), F.col("content")))
    # written to the shared folder: the model is called once a record, whichever of the two is asked for
    checked = cut(made.withColumn("errors", errors).drop("error"))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def record_status(records: DataFrame, valid: DataFrame, quarantined: DataFrame, least: int = 40) -> DataFrame:
    """(record_id, status, notes_ok, notes_quarantined, error): what became of each record of a run of ``distil``.

    ``ok`` if a note is valid, ``quarantined`` if notes came and none is, ``api_error`` if the call failed, ``skipped`` if
    both texts are too short, and ``ok`` without notes if the model gave none. Failed and quarantined
    records are tried again by a later run.
    """
    ids = records.select(F.col("id").cast("string").alias("record_id"), scrub(F.col("transcript"), F.col("pii_known")).alias("t"), scrub(F.col("notes"), F.col("pii_known")).alias("n"))
    short = (F.length("t") < least) & (F.length("n") < least)
    good = valid.groupBy(F.col("record").alias("record_id")).agg(F.count("*").alias("notes_ok"))
    failed = F.col("title").isNull() & F.col("kind").isNull() & F.col("content").isNull() & (F.size("errors") == 1)
    bad = quarantined.groupBy(F.col("record").alias("record_id")).agg(F.count_if(~failed).alias("notes_quarantined"), F.max(F.when(failed, F.col("errors")[0])).alias("error"))
    rows = ids.join(good, "record_id", "left").join(bad, "record_id", "left")
    ok, q = F.coalesce("notes_ok", F.lit(0)), F.coalesce("notes_quarantined", F.lit(0))
    status = F.when(short, "skipped").when(F.col("error").isNotNull(), "api_error").when((ok == 0) & (q > 0), "quarantined").otherwise("ok")
    return rows.select("record_id", status.alias("status"), ok.alias("notes_ok"), q.alias("notes_quarantined"), "error")


def run_stats(status: DataFrame) -> DataFrame:
    """One row: records by status and notes of a run."""
    has = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count_if(F.col("status") != "skipped").alias("processed"), *[has(s) for s in ("ok", "quarantined", "skipped", "api_error")], F.coalesce(F.sum("notes_ok"), F.lit(0)).alias("notes_ok"), F.coalesce(F.sum("notes_quarantined"), F.lit(0)).alias("notes_quarantined"))


def run_batch(records: DataFrame, model: Callable[[str, str], list[dict]], folder: str, least: int = 40) -> DataFrame:
    """Distils the records that no earlier run finished; appends notes, quarantine and checkpoint under ``folder``, returns ``run_stats``.

    The model is called once a record: its notes are written before anything else is made of them.
    """
    spark = records.sparkSession
    states = os.path.join(folder, "checkpoint")
    if os.path.isdir(states):
        records = open_records(records.withColumn("id", F.col("id").cast("string")), dumps.done_ids(spark, states))
    valid, quarantined = distil(records, model, least)
    status = cut(record_status(records, valid, quarantined, least))
    valid.write.mode("append").parquet(os.path.join(folder, "notes"))
    dumps.append_quarantine(quarantined, os.path.join(folder, "quarantine"))
    dumps.append_checkpoint(status, states)
    return run_stats(status)
