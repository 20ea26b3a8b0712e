import random

import numpy as np
from pyspark.sql import functions as F

from notewright.llm import spans as S


def brute(docs, span):
    seen = {}
    for k, t in docs:
        for p in range(len(t or "") - span + 1):
            seen.setdefault(t[p : p + span], set()).add(k)
    out = {}
    for k, t in docs:
        covered = set()
        for p in range(len(t or "") - span + 1):
            if len(seen[t[p : p + span]]) > 1:
                covered |= set(range(p, p + span))
        if covered:
            out[k] = len(covered)
    return out


def run(spark, docs, span=40, k=16, **params):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("doc", F.lit(1))
    return {r["doc_id"]: r["shared_chars"] for r in S.shared_lengths(df, span=span, k=k, **params).collect()}


def made(seed, n=40, alphabet="abcdef å😀\n"):
    rnd = random.Random(seed)
    text = lambda m: "".join(rnd.choices(alphabet, k=m))
    passages = [text(rnd.randint(30, 120)) for _ in range(6)]
    return [(i, text(rnd.randint(0, 90)) + "".join(rnd.choice(passages) + text(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 3)))) for i in range(n)]


def test_equals_all_windows(spark):
    for seed, pairwise in ((1, 12), (2, 1), (7, 2)):
        docs = made(seed)
        assert run(spark, docs, pairwise=pairwise) == brute(docs, 40)


def test_poor_texts(spark):
    docs = [(1, "a" * 300), (2, "a" * 100), (3, "ab" * 60), (4, "ba" * 60), (5, "a" * 39)]
    assert run(spark, docs) == brute(docs, 40)
    assert run(spark, docs, pairwise=3) == brute(docs, 40)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    run_ = S._seed_batches(40, 16)
    import pyarrow as pa

    for seed in range(5):
        t = "".join(random.Random(seed).choices("ab", k=500))
        batch = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array([t, t[:45]])], names=["rep", "text"])
        got = {(d, p, h) for b in run_(iter([batch])) for d, p, h in zip(*(c.to_pylist() for c in b.columns))}
        want = set()
        for d, x in ((7, t), (8, t[:45])):
            p, h = S.seed_positions(S.points(x), 40, 16)
            want |= {(d, i, j) for i, j in zip(p.tolist(), h.view(np.int64).tolist())}
        assert got == want


def test_defined_cases(spark):
    same = "".join(random.Random(3).choices("abcdefghij ", k=200))
    docs = [(1, same), (2, same), (3, None), (4, ""), (5, "x" * 50 + "y" * 50 + "x" * 50), (6, same[:39]), (None, same)]
    assert run(spark, docs) == {1: 200, 2: 200}
    assert run(spark, docs + docs[:1]) == {1: 200, 2: 200}
    assert run(spark, []) == {}
    inside = [(1, same + "z" * 9 + same), (2, "q" * 200)]
    assert run(spark, inside) == {}
    rnd = random.Random(9)
    long = "".join(rnd.choices("abcdefgh ", k=300_000))
    assert run(spark, [(1, long), (2, "w" * 100 + long[150_000:150_100])]) == {1: 100, 2: 100}


def test_seeds_meet_in_every_shared_span():
    rnd = random.Random(5)
    for _ in range(50):
        core = "".join(rnd.choices("ab", k=60))
        a, b = ("".join(rnd.choices("ab", k=80)) + core + "".join(rnd.choices("ab", k=80)) for _ in range(2))
        hs = [set(S.seed_positions(S.points(t), 60, 10)[1].tolist()) for t in (a, b)]
        assert hs[0] & hs[1]


def test_window_hashes():
    codes = S.points("abcabcabc" * 5)
    h = S.window_hashes(codes, 7, S._BASES[0])
    assert len(h) == len(codes) - 6 and h[0] == h[3] and len(set(h.tolist())) == 3
    assert len(S.window_hashes(codes[:3], 7, S._BASES[0])) == 0


def test_chains_are_in_order_and_lose_nothing():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        n = int(rnd.integers(1, 40))
        a, b = rnd.integers(0, 900, n), rnd.integers(0, 900, n)
        made_ = S.chain(a, b)
        assert sorted(i for c in made_ for i in c) == list(range(n))
        for c in made_:
            assert all(a[x] < a[y] and b[x] < b[y] for x, y in zip(c, c[1:]))
    a = np.array([0, 100, 200, 150]), np.array([50, 150, 250, 20])
    assert S.chain(*a)[0] == [0, 1, 2]


def test_the_best_chain_is_the_best():
    rnd = np.random.default_rng(6)
    for _ in range(40):
        n = int(rnd.integers(2, 9))
        a, b = rnd.permutation(2000)[:n], rnd.permutation(2000)[:n]
        path = S.chain(a, b, 64)[0]

        def score(p):
            s = 64.0
            for x, y in zip(p, p[1:]):
                s += min(64, a[y] - a[x], b[y] - b[x]) - 0.05 * (a[y] - a[x] + b[y] - b[x])
            return s

        best = 64.0
        order = sorted(range(n), key=lambda i: a[i])
        for mask in range(1, 2**n):
            p = [i for k, i in enumerate(order) if mask >> k & 1]
            if all(b[x] < b[y] for x, y in zip(p, p[1:])):
                best = max(best, score(p))
        assert score(path) >= 64.0 and score(path) <= best + 1e-9


def test_fuzzy_passages(spark):
    rnd = random.Random(4)
    a = "".join(rnd.choices("abcdefgh ", k=900))
    b = a[:400] + "XYZ" + a[405:]
    df = spark.createDataFrame([(1, a), (2, "pre " + b)], "doc_id long, text string")
    got = S.fuzzy_passages(df, span=100, k=32).orderBy(F.desc("anchors")).first()
    assert (got["doc_a"], got["doc_b"]) == (1, 2) and 0.97 < got["identity"] < 1 and got["a_end"] - got["a_start"] > 600


def test_fuzzy_passages_lose_no_link(spark):
    """Every window that two texts share lies in a row of both, or in rows with one representative where these overlap."""
    for seed, pairwise in ((1, 12), (2, 1), (3, 3)):
        docs = made(seed, n=60)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        text, direct, tied = {}, {}, {}
        for n, t in docs:
            text.setdefault(t, n)
        for r in S.fuzzy_passages(df, span=40, k=16, pairwise=pairwise).collect():
            direct.setdefault((r["doc_a"], r["doc_b"]), []).append(r)
            tied.setdefault(r["doc_b"], []).append(r)
        at = {}
        for t, n in text.items():
            for p in range(len(t) - 39):
                at.setdefault(t[p : p + 40], []).append((n, p))
        inside = lambda r, side, p: r[f"{side}_start"] <= p and p + 40 <= r[f"{side}_end"]
        pairs = set()
        for places in at.values():
            for a, p in places:
                for b, q in places:
                    if a < b:
                        pairs.add((a, b))
                        if any(inside(r, "a", p) and inside(r, "b", q) for r in direct.get((a, b), [])):
                            continue
                        assert any(
                            x["doc_a"] == y["doc_a"] and min(x["a_end"], y["a_end"]) - max(x["a_start"], y["a_start"]) >= 40
                            for x in tied.get(a, []) if inside(x, "b", p) for y in tied.get(b, []) if inside(y, "b", q)
                        ), (seed, a, b)
        assert len(pairs) > sum(map(len, direct.values())) or pairwise == 12


def test_one_passage_in_many_texts_gives_a_row_a_text(spark):
    rnd = random.Random(8)
    core = "".join(rnd.choices("abcdefgh ", k=840))
    docs = [(n, "".join(rnd.choices("ijklmnop ", k=50)) + core + "".join(rnd.choices("qrstuvwx ", k=50))) for n in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.fuzzy_passages(df).collect()
    tied = [r for r in got if r["doc_a"] == 0 and r["a_start"] <= 50 and r["a_end"] >= 890]
    assert {r["doc_b"] for r in tied} == set(range(1, 20))
    # of all 190 pairs only those that share a rare seed at an end of the passage have a row of their own
    assert len(got) < 95


def test_spans_are_the_characters_covered(spark):
    docs = made(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.shared_spans(df, span=40, k=16, pairwise=2).collect()
    held = {}
    for r in got:
        assert r["end"] - r["start"] >= 40
        held.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for ranges in held.values():
        ranges.sort()
        assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    assert {k: sum(b - a for a, b in v) for k, v in held.items()} == brute(docs, 40)
