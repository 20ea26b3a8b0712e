"""Joins whose sides Spark takes for small: what is sent by way of the driver must stay small."""

import contextlib

from notewright.operators import concepts, graph

MOST = "spark.sql.maxBroadcastTableSize"
#: What Spark sends after it has measured it is no matter here.
MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextlib.contextmanager
def sent_at_most(spark, size):
    spark.conf.set(MOST, size)
    spark.conf.set(MEASURED, "-1")
    try:
        yield
    finally:
        spark.conf.unset(MOST)
        spark.conf.unset(MEASURED)


def test_rare_token_links_sends_no_sets(spark, monkeypatch):
    # 100 terms that half of all documents have, and two that a document has with one other
    often = "transform(sequence(0, 99), i -> concat('t', 2 * i + pmod(hash(id, i), 2)))"
    docs = spark.range(2000).selectExpr("concat('d', id) AS title", f"concat({often}, array(concat('r', id div 2), concat('s', id div 2))) AS bag")
    for sent in (1 << 18, 10):
        monkeypatch.setattr(graph, "SENT", sent, raising=False)
        with sent_at_most(spark, "4m"):
            got = {(r["src"], r["dst"]) for r in graph.rare_token_links(docs, "title", "bag").collect()}
        assert got == {(f"d{i}", f"d{i ^ 1}") for i in range(2000)}


def test_greedy_absorption_sends_no_places(spark):
    name = "concat('a title of the usual length, number ', {})"
    n = 40_000
    pairs = spark.range(8 * n).selectExpr(f"{name.format(f'2 * (id % {n})')} AS a", f"{name.format(f'2 * (id % {n}) + 1')} AS b", "1.0D AS score")
    order = spark.range(2 * n).selectExpr(f"{name.format('id')} AS id", f"struct(-1L AS m, {name.format('id')} AS t) AS place")
    with sent_at_most(spark, "4m"):
        got = concepts.greedy_absorption(pairs, order, 0.5)
        assert got.count() == n
        assert got.filter("id >= absorbed").isEmpty()
