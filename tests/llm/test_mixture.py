from collections import Counter

from pyspark.sql import functions as F

from notewright.llm import mixture as M, queries


def test_siblings_come_before_ancestors():
    leaves = [
        {"path": ("d", "en", "a"), "weight": 0.4, "capacity": 10},
        {"path": ("d", "en", "b"), "weight": 0.2, "capacity": 1000},
        {"path": ("d", "sv", "c"), "weight": 0.2, "capacity": 1000},
        {"path": ("e", "en", "f"), "weight": 0.2, "capacity": 1000},
    ]
    got = M.budgets(leaves, 100)
    assert got == {("d", "en", "a"): 10, ("d", "en", "b"): 50, ("d", "sv", "c"): 20, ("e", "en", "f"): 20}
    leaves[1]["capacity"] = 5
    assert M.budgets(leaves, 100) == {("d", "en", "a"): 10, ("d", "en", "b"): 5, ("d", "sv", "c"): 65, ("e", "en", "f"): 20}
    for leaf in leaves:
        leaf["capacity"] = 1
    assert sum(M.budgets(leaves, 100).values()) == 4


def frames(spark):
    rows = [(i, "word " * (i % 7 + 1), "en", " Big-One ", "clash") for i in range(200)] + [(1000 + i, "kort text", "SV", "small", "x") for i in range(3)]
    rows += [(2000, None, "en", "small", "x"), (2001, "", "en", "big_one", "x"), (2002, "not listed", "en", "elsewhere", "x"), (2003, "no source", None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 9), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_uses(spark):
    docs, targets = frames(spark)
    sizes = {r["doc_id"]: r["n_tokens"] for r in M.counted(docs).collect()}
    uses = M.mixture(docs, targets, total_tokens=300).collect()
    by_source, per_doc = Counter(), Counter()
    for r in uses:
        by_source[r["source"]] += r["used_tokens"]
        per_doc[(r["doc_id"], r["epoch"])] += 1
        assert 0 < r["used_tokens"] <= sizes[r["doc_id"]]
    small = sum(v for k, v in sizes.items() if 1000 <= k < 2000)
    assert by_source == {"small": 3 * small, "big_one": 300 - 3 * small}  # small is at its limit, the rest goes on
    assert max(per_doc.values()) == 1 and max(e for (k, e) in per_doc if k >= 1000) == 3
    assert sum(r["used_tokens"] < sizes[r["doc_id"]] for r in uses) <= 2  # at most one cut document a leaf
    again = M.mixture(docs, targets, total_tokens=300).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, uses))
    other = M.mixture(docs, targets, total_tokens=300, seed=5).collect()
    assert {r["doc_id"] for r in other} != {r["doc_id"] for r in uses}


def test_ranges_do_not_change_the_budget(spark):
    docs, targets = frames(spark)
    sizes = M.counted(docs)
    leaves = M.plan(sizes, targets, 333)
    for per_range in (1, 7, 4096):
        assert M.mix(sizes, leaves, per_range=per_range).agg(F.sum("used_tokens")).first()[0] == leaves.agg(F.sum("budget")).first()[0]


def test_shares_and_empty(spark, data):
    docs, targets = frames(spark)
    assert M.mixture(docs.limit(0), targets).count() == 0
    assert M.reached_shares(docs.limit(0), targets).filter("reached_share > 0").count() == 0
    rows = queries.p7_shares(spark, data).collect()
    assert abs(sum(r["reached_share"] for r in rows) - 1) < 1e-6 and all(r["most_uses"] <= r["max_repeats"] for r in rows)
    assert all(r["used_tokens"] <= r["tokens"] * r["max_repeats"] for r in rows)
