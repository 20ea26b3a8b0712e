"""Ranking, vector search, graphs: against plain Python."""

import difflib
import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from notewright.operators import components, dense, graph, lexical


def test_bm25(spark):
    docs = {"a": ["heart", "rate", "heart"], "b": ["rate"], "c": ["other"], "d": []}
    query = ["heart", "rate", "rate", "absent"]
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    want = {}
    for k, d in docs.items():
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query if d.count(t))
        if s:
            want[k] = round(s, 6)
    frame = spark.createDataFrame(list(docs.items()), "title string, bag array<string>")
    asked = spark.createDataFrame([("q", "heart rate rate absent")], "id string, text string")
    got = {r["doc"]: r["score"] for r in lexical.bm25(frame, "title", "bag", asked, "id", "text").collect()}
    assert got == want
    assert lexical.bm25(frame.limit(0), "title", "bag", asked, "id", "text").count() == 0


def test_fuse_and_ties(spark):
    one = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, doc string, rank int")
    two = spark.createDataFrame([("q", "b", 1)], "query string, doc string, rank int")
    got = {r["doc"]: r["score"] for r in lexical.fuse(one, two).collect()}
    assert got == {"a": round(1 / 61, 6), "b": round(1 / 62 + 1 / 61, 6)}
    tied = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0)], "query string, doc string, score double")
    assert [r["doc"] for r in lexical.top_k(tied, 1).collect()] == ["a"]


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(dense, "BLOCK", 16)
    got = defaultdict(list)
    for r in dense.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 4, least=0.1).orderBy("query", "rank").collect():
        got[r["query"]].append(r["doc"])
    f = x.astype(np.float32).astype(float)
    for q in (0, 20, 40):
        sims = np.round(f[q] @ f.T, 6)
        want = sorted((i for i in range(60) if i != q and sims[i] >= 0.1), key=lambda i: (-sims[i], -i))[:4]
        assert got[q] == want


def test_components(spark):
    random.seed(3)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for v in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def random_graph(seed):
    random.seed(seed)
    edges = {}
    for _ in range(60):
        a, b = random.sample("abcdefghijklmnopqrst", 2)
        edges[(a, b)] = edges[(b, a)] = round(random.uniform(0.2, 1), 2)
    return edges


def test_activation_settles_like_best_first(spark):
    edges = random_graph(2)
    frame = spark.createDataFrame([(a, b, w, "authored") for (a, b), w in edges.items()], "src string, dst string, weight double, kind string")
    got = {r["node"]: r["activation"] for r in graph.activation(frame, spark.createDataFrame([("a",)], "node string"), settled=8).collect()}
    best, done, heap = {"a": 1.0}, {}, [(-1.0, "a")]
    while heap and len(done) < 8:
        s, node = heapq.heappop(heap)
        if node in done or -s < best[node]:
            continue
        done[node] = -s
        for (x, y), w in edges.items():
            flow = round(-s * 0.65 * w, 9)
            if x == node and flow >= 0.05 and flow > best.get(y, 0):
                best[y] = flow
                heapq.heappush(heap, (-flow, y))
    assert got == done


def test_neighbours(spark):
    edges = random_graph(5)
    frame = spark.createDataFrame(list(edges), "src string, dst string")
    got = {(r["node"], r["hops"]) for r in graph.neighbours(frame, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    one = {b for a, b in edges if a == "a"}
    two = {b for a, b in edges if a in one} - one - {"a"}
    assert got == {(n, 1) for n in one} | {(n, 2) for n in two}
    assert graph.neighbours(frame, spark.createDataFrame([("zz",)], "node string"), 2).count() == 0


def test_link_tiers(spark):
    titles = spark.createDataFrame([("Gait in weight gain",), ("Reading the Temsy response",), ("Cold hands at night",)], "title string")
    links = spark.createDataFrame([("gait IN weight gain",), ("Reading the Temsi response",), ("night hands",), ("nothing alike",), (None,)], "link string")
    got = {r["link"]: (r["title"], r["method"]) for r in graph.resolve_links(links, titles).collect()}
    assert got == {
        "gait IN weight gain": ("Gait in weight gain", "exact"),
        "Reading the Temsi response": ("Reading the Temsy response", "fuzzy"),
        "night hands": ("Cold hands at night", "jaccard"),
    }


def test_rrf_fuse_ranks_every_note(spark, tmp_path):
    from notewright import queries

    # the shorter the title, the fewer times its text has the word: first in one ranking, last in the other
    notes = [("heart " + " ".join(f"word{i}{n}" for i in range(n)), [], "heart " * (6 * n), f"{n:03}.md") for n in range(80)]
    spark.createDataFrame(notes, "title string, tags array<string>, content string, file_name string").write.parquet(str(tmp_path / "notes.parquet"))
    spark.createDataFrame([("c", "heart")], "id string, title string").write.parquet(str(tmp_path / "concepts.parquet"))
    where = str(tmp_path)
    bag = queries._index(spark, where)
    lists = [lexical.bm25(bag, "title", "bag", queries._asked(spark, where), "id", "title").collect(), queries._title_bm25(spark, where).collect()]
    assert [len(x) for x in lists] == [80, 80]
    score = Counter()
    for rows in lists:
        for rank, r in enumerate(sorted(rows, key=lambda r: (-r["score"], r["doc"])), 1):
            score[r["doc"]] += 1 / (60 + rank)
    want = sorted(((-round(s, 6), doc) for doc, s in score.items()))[:10]
    got = queries.rrf_fuse(spark, where).orderBy("rank").collect()
    assert [(-r["score"], r["doc"]) for r in got] == want


def test_fuzzy_links_equal_brute_force(spark):
    rnd = random.Random(8)
    words = ["hypertension", "tachycardia", "gait", "Reading the response", "cold hands at night", "å ä ö", "stroke", "aa", "", "x" * 260]

    def misspelt(w):
        c = list(w)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(c))
            c[at : at + rnd.randint(0, 2)] = rnd.choices("abceinost ", k=rnd.randint(0, 2))
        return "".join(c)

    titles = sorted({misspelt(w) for w in words for _ in range(12)} | {"Hypertension", "tachycardia"})
    links = sorted({misspelt(w) for w in words for _ in range(6)} | {"hypertensoin", "tachykardia"})
    want = {}
    for a in links:
        best = max((round(difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), 6), b) for b in titles)
        if best[0] >= graph.FUZZY:
            want[a] = (best[1], best[0])
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((links, "link"), (titles, "title"))]
    got = {r["link"]: (r["title"], r["ratio"]) for r in graph.fuzzy_links(*frames).collect()}
    assert got == want and want["hypertensoin"] and want["tachykardia"]


def test_weighted_graph_prefers_authored(spark):
    a = spark.createDataFrame([("x", "y")], "src string, dst string")
    i = spark.createDataFrame([("y", "x", 0.9), ("x", "z", 0.95), ("z", "z", 0.9)], "src string, dst string, similarity double")
    got = {(r["src"], r["dst"]): (r["weight"], r["kind"]) for r in graph.weighted_graph(a, i).collect()}
    assert got == {("x", "y"): (1.0, "authored"), ("y", "x"): (1.0, "authored"), ("x", "z"): (0.85, "inferred"), ("z", "x"): (0.85, "inferred")}
    nodes = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "node string")
    assert graph.graph_stats(graph.weighted_graph(a, i), nodes).first().asDict() == {"nodes": 4, "edges": 2, "avg_degree": 1.0, "isolated": 1}


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(F.round(dense.cosine(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [round(1 / math.sqrt(2), 6), 0.0]


def test_encode_only_what_changed(spark):
    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "k long, t string")
    store = spark.createDataFrame([], "key long, digest string, model string")
    rows = dense.encode(dense.unencoded(texts, "k", "t", store, "m"), lambda batch: [[len(t), 0.0] for t in batch], "m", batch=2)
    assert {r["key"]: list(r["v"]) for r in rows.collect()} == {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.0, 0.0]}
    changed = spark.createDataFrame([(1, "aa"), (2, "new")], "k long, t string")
    assert [r["key"] for r in dense.unencoded(changed, "k", "t", rows, "m").collect()] == [2]
    assert dense.unencoded(changed, "k", "t", rows, "other").count() == 2


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert dense.nearest(empty, empty, 3).count() == 0


def test_vectors_are_stored_and_asked_with_a_prefix(spark, tmp_path):
    encoder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    rows = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    none = spark.createDataFrame([], "key long, digest string, model string")
    where = str(tmp_path / "store")
    dense.add_to_store(dense.encode(dense.unencoded(rows, "id", "text", none, "m"), encoder, "m"), where)
    changed = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "x")], "id long, text string")
    new = dense.unencoded(changed, "id", "text", spark.read.parquet(where), "m")
    assert sorted(r["key"] for r in new.collect()) == [2, 3]
    dense.add_to_store(dense.encode(new, encoder, "m"), where)
    now = dense.stored(spark, where, "m", dense.unencoded(changed, "id", "text", none, "m"))
    assert sorted(r["key"] for r in now.collect()) == [1, 2, 3] and dense.stored(spark, where, "n", new).count() == 0
    asked = dense.encode(dense.unencoded(rows, "id", "text", none, "m"), encoder, "m", prefix="ask: ")
    assert round(asked.filter("key = 1").first()["v"][0] / asked.filter("key = 1").first()["v"][1]) == 7


def test_open_links_are_nodes(spark):
    notes = spark.createDataFrame([("A", ["B", "nowhere", "A", None]), ("B", None)], "title string, links array<string>")
    assert {tuple(r) for r in graph.open_adjacency(notes).collect()} == {("A", "B"), ("B", "A"), ("A", "nowhere"), ("nowhere", "A")}


def test_ranks_equal_one_sort(spark):
    rnd = random.Random(3)
    rows = [(q, f"d{n}", round(rnd.choice([0.0, 1.5, rnd.random() * 9]), 3)) for q in "ab" for n in range(150)] + [("c", "d", 0.0)]
    got = {(r["query"], r["doc"]): r["rank"] for r in lexical.ranks(spark.createDataFrame(rows, "query string, doc string, score double"), parts=7).collect()}
    for q in "abc":
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[q, r[1]] for r in mine] == list(range(1, len(mine) + 1))
