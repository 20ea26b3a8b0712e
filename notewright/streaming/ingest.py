"""Incremental ingestion of evidence as a stream: each micro-batch is merged into the stored strengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def evidence_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_counts(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """(day, concept_id, observations, against): evidence per day of loading; rows delivered twice within the delay count once."""
    timed = stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    once = timed.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["concept_id", "ord", "source", "detail"])
    day = F.window("loaded_at", "1 day")
    return once.groupBy(day.alias("w"), "concept_id").agg(F.count("*").alias("observations"), F.count_if(F.coalesce("contradicts", F.lit(False))).alias("against")).select(
        F.col("w.start").alias("day"), "concept_id", "observations", "against"
    )


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every available row through ``each`` in micro-batches, then the query ends; a restart goes on at the checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
