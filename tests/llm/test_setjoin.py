import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from notewright.llm import queries, setjoin as S
from notewright.session import table


def brute(sets, threshold, least):
    kept = {k: s for k, s in sets.items() if len(s) >= least}
    keys = sorted(kept)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(kept[a] & kept[b]) >= threshold * len(kept[a] | kept[b]) - 1e-9}


def got_pairs(spark, sets, threshold, least, **params):
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, v array<string>")
    return {tuple(r) for r in S.similar_pairs(df.withColumn("values", F.col("v")), "id", "values", threshold, least, **params).collect()}


def test_two_tables(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(20)] + ["hot"] * 25
    sides = [{i: set(random.choices(words, k=random.randint(1, 8))) for i in range(n)} for n in (90, 70)]
    left = spark.createDataFrame([(k, sorted(v)) for k, v in sides[0].items()] + [(None, ["a", "b"]), (500, None)], "id long, v array<string>")
    right = spark.createDataFrame([(f"r{k}", sorted(v) + [None]) for k, v in sides[1].items()], "name string, v array<string>").withColumn("key", F.lit(1))
    want = {(a, f"r{b}") for a, x in sides[0].items() for b, y in sides[1].items() if min(len(x), len(y)) >= 2 and len(x & y) >= 0.6 * len(x | y) - 1e-9}
    for params in ({}, {"postings": 1, "max_tokens": 2}):
        assert {tuple(r) for r in S.similar_between(left, "id", "v", right, "name", "v", 0.6, 2, **params).collect()} == want
    assert S.similar_between(left.limit(0), "id", "v", right, "name", "v", 0.6, 2).count() == 0


def test_a_hot_set_of_tokens_is_joined_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 3)
    sets = {i: {"a", "b", "c", "d", f"x{i % 7}"} for i in range(40)}
    assert got_pairs(spark, sets, 0.6, 2, postings=2, max_tokens=2) == brute(sets, 0.6, 2)


def test_few_ranked_tokens(spark, monkeypatch):
    monkeypatch.setattr(S.ranked_tokens, "__defaults__", (3,))
    random.seed(8)
    sets = {i: set(random.choices([f"w{j}" for j in range(15)], k=random.randint(2, 7))) for i in range(80)}
    assert got_pairs(spark, sets, 0.6, 2, postings=4) == brute(sets, 0.6, 2)


@pytest.mark.parametrize("threshold,postings,longest", [(0.6, 2, 3), (0.75, 1, 2), (0.5, 40, 1), (0.9, 3, 4)])
def test_equals_all_pairs(spark, threshold, postings, longest):
    random.seed(longest)
    words = [f"w{i}" for i in range(25)] + ["hot"] * 30  # one word in nearly every set
    sets = {i: set(random.choices(words, k=random.randint(1, 9))) for i in range(150)}
    sets |= {1000 + i: {"same", "set", "here"} for i in range(12)}
    assert got_pairs(spark, sets, threshold, 2, postings=postings, max_tokens=longest) == brute(sets, threshold, 2)


def test_defined_cases(spark):
    rows = [(1, ["a", "b", "c", None, "a"]), (2, ["c", "b", "a"]), (3, None), (4, []), (None, ["a", "b", "c"]), (5, ["a"]), (2, ["c", "b", "a"])]
    df = spark.createDataFrame(rows, "id long, values array<string>").withColumn("key", F.lit("x")).withColumn("class", F.lit("y")).withColumn("size", F.lit(1))
    df = df.withColumn("values", F.filter("values", lambda v: v.isNotNull()))
    assert {tuple(r) for r in S.similar_pairs(df, "id", "values", 0.6, 3).collect()} == {(1, 2)}
    assert S.similar_pairs(df.limit(0), "id", "values", 0.6, 3).count() == 0
    long = {1: {f"t{i}" for i in range(5000)}, 2: {f"t{i}" for i in range(4500)}, 3: {f"t{i}" for i in range(2000, 9000)}}
    assert got_pairs(spark, long, 0.75, 30) == {(1, 2)}


def test_sets_of_notes(spark):
    rows = [(["#A b", " a__B", " c ", "", "  ", None, "#"],), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(S.tag_set(F.col("t"))).collect()] == [["a-b", "c"], None]
    assert spark.createDataFrame([("Äb1 x, X y2",)], "t string").select(S.word_set(F.col("t"))).first()[0] == ["b1", "x", "y2"]


def test_notes_and_classes(spark, data):
    notes = table(spark, data, "notes")
    sets = {r["note_id"]: set(re.findall("[a-z0-9]+", (r["content"] or "").lower())) for r in notes.collect()}
    want = brute(sets, 0.75, 30)
    assert {tuple(r)[1:] for r in queries.p3_found(spark, data).filter("facet = 'content'").collect()} == want
    of = {r["note_id"]: r for r in S.linked_classes(notes, "content").collect()}
    linked = defaultdict(set)
    for a, b in want:
        if of[a]["class_id"] != of[b]["class_id"]:
            linked[of[a]["class_id"]].add(of[b]["class_id"])
            linked[of[b]["class_id"]].add(of[a]["class_id"])
    assert all(r["links"] == len(linked[r["class_id"]]) for r in of.values())
