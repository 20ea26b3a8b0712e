"""Term statistics, BM25 ranking and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from notewright.functions.text import tokens
from notewright.session import cut

#: BM25 and rank fusion.
K1, B = 1.5, 0.75
FUSION_K = 60
#: Stands for the document itself among its terms; no term has a space.
_MARK = " "


def document_frequency(docs: DataFrame, key: str, bag: str) -> DataFrame:
    """(term, df, tf): in how many documents a term stands, and how often."""
    terms = docs.select(F.col(key).alias("doc"), F.explode(bag).alias("term"))
    per_doc = terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, key: str, bag: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(query, doc, score): BM25 of every document that shares a term with a query; repeated query terms count again.

    The index is read once: each document's terms, and a mark that carries its length, are joined with
    the terms of the queries (a stated, small set; Spark broadcasts them only under its own size
    limit) before any count; what is left is counted and written to the shared folder.
    """
    asked = queries.select(F.col(query_key).alias("query"), F.explode(tokens(F.col(query_text))).alias("term"))
    asked = asked.groupBy("query", "term").agg(F.count("*").alias("times"))
    sized = docs.select(F.col(key).alias("doc"), F.col(bag).alias("bag"), F.size(bag).alias("len"))
    wanted = asked.select("term").unionByName(asked.sparkSession.createDataFrame([(_MARK,)], "term string")).distinct()
    terms = sized.select("doc", "len", F.explode(F.concat("bag", F.array(F.lit(_MARK)))).alias("term")).join(wanted, "term", "left_semi")
    counted = cut(terms.groupBy("term", "doc", "len").agg(F.count("*").alias("f")))
    corpus = counted.filter(F.col("term") == _MARK).agg(F.sum("f").alias("n"), (F.sum(F.col("len") * F.col("f")) / F.sum("f")).alias("avg_len"))
    postings = counted.filter(F.col("term") != _MARK)
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row of totals
    weights = frequency.crossJoin(corpus).select("term", idf.alias("idf"), "avg_len")
    hits = asked.join(weights, "term").join(postings, "term")
    gain = F.col("times") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.groupBy("query", "doc").agg(F.round(F.sum(gain), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best of each query with their rank; ties by key."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(*rankings: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of (query, doc, rank) rankings."""
    both = rankings[0].select("query", "doc", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query", "doc", "rank"))
    return both.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("score"))


def ranks(scored: DataFrame, by: str = "query", score: str = "score", tie: str = "doc", parts: int = 64) -> DataFrame:
    """``scored`` with the rank of every row of its query; ties by key.

    A query's rows are parted by ranges of their score: ranks inside a range, and the numbers of rows in
    the ranges before it, so no task sorts all hits of a query. Scores are not negative.
    """
    best = scored.groupBy(by).agg(F.max(score).alias("_best"))
    rows = scored.join(best, by).withColumn("_part", F.floor((1 - F.col(score) / F.when(F.col("_best") > 0, F.col("_best"))) * parts))
    rows = cut(rows.withColumn("_part", F.coalesce("_part", F.lit(0))).drop("_best"))
    sizes = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` + 1 rows
    starts = sizes.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_part").orderBy(F.desc(score), F.asc(tie))
    return rows.join(starts, [by, "_part"]).withColumn("rank", (F.row_number().over(inside) + F.col("_start")).cast("int")).drop("_part", "_start")


def normalised(scored: DataFrame, by: str = "query", score: str = "score") -> DataFrame:
    """Scores divided by the best of their query."""
    best = scored.groupBy(by).agg(F.max(score).alias("_best"))
    return scored.join(best, by).withColumn(score, F.round(F.col(score) / F.col("_best"), 6)).drop("_best")
