"""Incremental ingestion against a plain one-by-one version."""

import random

from pyspark.sql import functions as F

from notewright.operators import concepts as C, ingest as I

CONCEPT = "id string, title string, content string, tags array<string>, aliases array<string>, links array<string>, applies_norm array<string>"
ITEM = "item long, place long, title string, content string, source string, observed_on string, detail string, tags array<string>"
MERGE, LINK = 0.9, 0.6


def one_by_one(concepts, items, sims_store, sims_batch, mode):
    held = {c[0]: {"title": c[1], "tags": list(c[3] or []), "aliases": list(c[4] or []), "links": list(c[5] or [])} for c in concepts}
    actions, evidence, made = {}, [], {}
    for item, _, title, _, source, _, detail, tags in items:
        near = [(s, -1, t) for (i, t), s in sims_store.items() if i == item] + [(s, o, made[o]) for (i, o), s in sims_batch.items() if i == item and o in made and o < item]
        near.sort(reverse=True)
        best = near[0] if near else (0.0, -1, None)
        if best[0] >= MERGE:
            target = held[best[2]]
            if title != target["title"] and title not in target["aliases"]:
                target["aliases"].append(title)
            target["tags"] += [t for t in dict.fromkeys(tags or []) if t not in target["tags"]]
            evidence.append((best[2], source, detail or title))
            actions[item] = ("merge", best[2])
            continue
        if mode == "harness" and best[0] >= LINK:
            actions[item] = ("ambiguous", best[2])
            continue
        base = "".join(c if c.isalnum() else "-" for c in title.lower()).strip("-")
        cid, n = base, 2
        while cid in held:
            cid, n = f"{base}-{n}", n + 1
        links = []
        for s, _, other in [x for x in near if x[0] >= LINK][:3]:
            if held[other]["title"] not in links:
                links.append(held[other]["title"])
            if title not in held[other]["links"]:
                held[other]["links"].append(title)
        held[cid] = {"title": title, "tags": list(tags or []), "aliases": [], "links": links}
        made[item] = cid
        evidence.append((cid, source, detail or title))
        actions[item] = ("link" if best[0] >= LINK else "create", best[2] if best[0] >= LINK else None)
    return actions, held, evidence


def case(seed):
    rnd = random.Random(seed)
    concepts = [(f"c{n}", f"Concept {n}", "text", ["old"], None, [], None) for n in range(6)]
    items = [(n, n, rnd.choice(["New one", "new one", f"Title {n}", "Concept 2"]), "t", f"t-{n}", None, rnd.choice([None, "", "told"]), rnd.choice([None, ["a", "b"], ["old", "c"]])) for n in range(14)]
    store = {(n, f"c{rnd.randrange(6)}"): round(rnd.random(), 6) for n in range(14) for _ in range(3)}
    batch = {(a, b): round(rnd.random(), 6) for a in range(14) for b in range(14) if a != b and rnd.random() < 0.4}
    return concepts, items, store, batch


def test_a_batch_equals_one_by_one(spark):
    for seed, mode in ((1, "none"), (2, "harness"), (3, "none")):
        concepts, items, store, batch = case(seed)
        want = one_by_one(concepts, items, store, batch, mode)
        near = spark.createDataFrame([(i, t, s) for (i, t), s in store.items()], "item long, target string, score double")
        same = spark.createDataFrame([(i, o, s) for (i, o), s in batch.items()], "item long, other long, score double")
        got = I.ingest(spark.createDataFrame(concepts, CONCEPT), spark.createDataFrame(items, ITEM), near, same, mode, MERGE, LINK)
        assert {r["item"]: (r["action"], r["target"]) for r in got["decisions"].collect()} == want[0]
        changed = {r["id"]: r for r in got["concepts"].collect()}
        first = {c[0]: {"title": c[1], "tags": c[3], "aliases": c[4] or [], "links": c[5]} for c in concepts}
        for k, v in want[1].items():
            if v != first.get(k):
                r = changed.pop(k)
                assert (r["title"], r["tags"], r["aliases"], sorted(r["links"])) == (v["title"], v["tags"], v["aliases"], sorted(v["links"])), (seed, k)
        assert all({x: r[x] for x in ("title", "tags", "aliases", "links")} == first[k] for k, r in changed.items())
        assert sorted((r["id"], r["source"], r["detail"]) for r in got["evidence"].collect()) == sorted(want[2])
        assert got["pending"].count() == sum(a == "ambiguous" for a, _ in want[0].values())


def test_pending_items_are_settled(spark):
    concepts = spark.createDataFrame([("c", "C", "t", [], [], [], []), ("d", "D", "t", [], [], [], [])], CONCEPT)
    items = spark.createDataFrame([(1, 1, "One", "x", "t-1", None, None, ["a"]), (2, 2, "Two", "x", "t-2", None, None, None)], ITEM)
    near = spark.createDataFrame([(1, "c", 0.7), (2, "d", 0.7)], "item long, target string, score double")
    none = spark.createDataFrame([], "item long, other long, score double")
    first = I.ingest(concepts, items, near, none, "harness", MERGE, LINK)
    assert first["concepts"].count() == 0 and first["evidence"].count() == 0
    got = I.settle_pending(concepts, first["pending"], spark.createDataFrame([(1, "d"), (2, None)], "item long, target string"), LINK)
    out = {r["id"]: r for r in got["concepts"].collect()}
    assert out["d"]["aliases"] == ["One"] and out["d"]["tags"] == ["a"] and out["d"]["links"] == ["Two"] and out["two"]["links"] == ["D"]
    assert {r["id"] for r in got["evidence"].collect()} == {"d", "two"}
    assert I.ingest(concepts, items.limit(0), near, none)["decisions"].count() == 0


def test_slugs_look_at_those_in_use(spark):
    names = ["a", "a", "a-2", "a", "b", "b-2-2", "b-2", "b-2", "c", "c", ""]
    want, taken = [], {"c", "c-2", "zz"}
    for s in names:
        out, n = s, 2
        while out in taken:
            out, n = f"{s}-{n}", n + 1
        taken.add(out)
        want.append(out)
    rows = spark.createDataFrame(list(enumerate(names)), "k long, s string")
    used = spark.createDataFrame([("c",), ("c-2",), ("zz",)], "s string")
    assert [r["slug"] for r in C.unique_slugs(rows, "k", "s", "k", used).orderBy("k").collect()] == want
    assert C.unique_slugs(rows.limit(0), "k", "s", "k").count() == 0


def test_running_sums_in_ranges(spark):
    rows = [(g, n, (n * 7) % 5) for g in ("x", None) for n in range(60)]
    got = C.running(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], "o", F.col("v"), "sum", width=8).collect()
    assert len(got) == len(rows) and all(r["sum"] == sum((n * 7) % 5 for n in range(r["o"] + 1)) for r in got)


def test_evidence_is_taken_in_once(spark):
    e = [("keep", 1, "t-1", "seen"), ("keep", 2, None, "odd"), ("gone", 1, "t-1", "seen"), ("gone", 2, "t-1", "other"), ("gone", 3, None, None), ("else", 1, "t-1", "seen")]
    df = spark.createDataFrame(e, "concept_id string, ord int, source string, detail string")
    pair = spark.createDataFrame([("gone", "keep"), ("gone", "keep")], "id string, into string")
    once = C.absorb_evidence(df, pair)
    want = {("keep", 1, "t-1", "seen"), ("keep", 2, None, "odd"), ("keep", 3, "t-1", "other"), ("keep", 4, None, None), ("else", 1, "t-1", "seen")}
    assert {tuple(r) for r in once.collect()} == want
    again = once.unionByName(df.filter("concept_id = 'gone'"))
    assert {tuple(r) for r in C.absorb_evidence(again, pair).collect()} == want
