"""Vector search: stated queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Queries that one block of the query side holds; a block is what one task compares with its rows.
BLOCK = 2048


def unencoded(texts: DataFrame, key: str, text: str, store: DataFrame, model: str) -> DataFrame:
    """(key, text, digest): rows whose text this model has not encoded yet; the store has key, digest, model."""
    rows = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    return rows.join(store.filter(F.col("model") == model).select("key", "digest"), ["key", "digest"], "left_anti")


def encode(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], model: str, batch: int = 32, prefix: str = "") -> DataFrame:
    """(key, v, digest, model): unit vectors of (key, text, digest) rows by an injected encoder.

    The encoder is called with up to ``batch`` texts inside the tasks; its vectors are always brought
    to unit length, a zero vector stays zero. Encoders that tell questions from texts get the questions
    with their instruction as ``prefix``; the key and digest stay those of the text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            made: list[np.ndarray] = []
            for at in range(0, len(df), batch):
                for v in encoder([prefix + t for t in df["text"].iloc[at : at + batch]]):
                    x = np.asarray(v, dtype=np.float64)
                    made.append(x / (np.linalg.norm(x) or 1.0))
            yield pd.DataFrame({"key": df["key"], "v": made, "digest": df["digest"], "model": model})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text", "digest").mapInPandas(run, f"key {kind}, v array<float>, digest string, model string")


def add_to_store(encoded: DataFrame, folder: str) -> None:
    """Adds (key, v, digest, model) rows to a stored table of vectors; ``unencoded`` asks it what is there already."""
    encoded.write.mode("append").partitionBy("model").parquet(folder)


def stored(spark: SparkSession, folder: str, model: str, texts: DataFrame) -> DataFrame:
    """(key, v) of a model for the texts (key, digest) as they are now; older versions of a text are passed over."""
    return spark.read.parquet(folder).filter(F.col("model") == model).join(texts.select("key", "digest"), ["key", "digest"], "left_semi").dropDuplicates(["key"]).select("key", "v")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def _best_of(width: int, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs, ids, vs = [], [], []
            for query_ids, query_vecs, row_ids, row_vecs in zip(*(batch.column(n) for n in range(4))):
                q = np.asarray(query_vecs.values.flatten(), dtype=np.float64).reshape(-1, width)
                r = np.asarray(row_vecs.values.flatten(), dtype=np.float64).reshape(-1, width)
                qi, ri = np.asarray(query_ids.values), np.asarray(row_ids.values)
                sims = np.round(q @ r.T, 6)
                sims[qi[:, None] == ri[None, :]] = -np.inf
                sims[sims < least] = -np.inf
                for i in range(len(qi)):
                    order = np.lexsort((-ri, -sims[i]))[:k]  # ties: the larger key
                    order = order[np.isfinite(sims[i][order])]
                    qs.append(np.full(len(order), qi[i]))
                    ids.append(ri[order])
                    vs.append(sims[i][order])
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (qs, ids, vs)], names=["query", "doc", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", least: float = -1.0) -> DataFrame:
    """(query, doc, score, rank): for each query the k most similar other rows, exactly; ties go to the larger key.

    Vectors of unit length. Both sides are packed into blocks by a hash of their key; each pair of a
    query block and a row block is one matrix product that keeps k rows per query, so what is
    shuffled is blocks and k partial results per query and row block. The number of queries is
    the caller's statement; rows may be any number.
    """
    first = queries.select(vector).filter(F.col(vector).isNotNull()).first()
    width = len(first[0]) if first else 0
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == width))
    asked = queries.filter(F.col(vector).isNotNull() & (F.size(vector) == width))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // BLOCK))
        packed = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("block"))
        return packed.groupBy("block").agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vecs"))

    pairs = blocks(asked, "q").drop("block").crossJoin(blocks(rows, "r").drop("block"))  # pairs of blocks, not of rows
    part = pairs.select("q_ids", "q_vecs", "r_ids", "r_vecs").mapInArrow(_best_of(width, k, least), "query long, doc long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("doc"))
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
