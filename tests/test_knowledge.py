"""Norms, concepts, sources, plans and streaming on small inputs."""

import datetime
import random
import sqlite3

from pyspark.sql import functions as F

from notewright.operators import concepts as C, norms as N
from notewright.plans import api, compile as compile_plan, distill, retrieve
from notewright.sources import dumps, markdown
from notewright.streaming import ingest

NORM = "id string, current string, authority string, valid_from date, last_verified date, volatility string, thresholds map<string,string>, supersedes array<struct<name:string,until:date,authority:string,migration:string>>, notes string, aliases array<string>, ord int"
NOTE = "note_id long, title string, kind string, content string, tags array<string>, links array<string>, applies_norm array<string>, source_transcript string, observed_on string, extracted_by string, confidence double, source string, file_name string"
D = datetime.date


def norms(spark):
    rows = [
        ("norm:a", "ALPHA-2", "Board", D(2020, 1, 1), D(2025, 8, 31), "12mo", {"t": "4"}, [("ALPHA-1", D(2020, 1, 1), None, "Count again")], "stroke risk", ["alpha score"], 0),
        ("norm:b", "BETA", "Board", None, None, None, None, [], None, None, 1),
        ("norm:c", "GAMMA", None, None, D(2026, 8, 1), "2y", None, None, "bleeding", ["Alpha Score"], 2),
    ]
    return spark.createDataFrame(rows, NORM)


def note(n, title, content="", tags=(), links=(), file=None, day=None):
    return (n, title, "pattern", content, list(tags), list(links), [], str(n), day, "x", 0.5, "s", file or f"{n}.md")


def test_norms(spark):
    table = norms(spark)
    names = {r["name"]: (r["norm_id"], r["is_retired"]) for r in N.norm_names(table).collect()}
    assert names == {"alpha-2": ("norm:a", False), "alpha-1": ("norm:a", True), "alpha score": ("norm:c", False), "beta": ("norm:b", False), "gamma": ("norm:c", False)}
    assert [r["id"] for r in N.stale(table, "2026-08-27").orderBy("id").collect()] == ["norm:a", "norm:b"]
    assert [r["id"] for r in N.stale(table, "2026-08-26").orderBy("id").collect()] == ["norm:b"]
    asked = spark.createDataFrame([("norm:b",), (" Alpha-1 ",), ("nope",)], "asked string")
    assert {r["asked"]: (r["norm_id"], r["found_by"]) for r in N.lookup(asked, "asked", table).collect()} == {"norm:b": ("norm:b", "id"), " Alpha-1 ": ("norm:a", "retired name"), "nope": (None, "missing")}
    texts = spark.createDataFrame([(1, "We used alpha-1, and ALPHA-1x"), (2, "ALPHA-1x alone, alpha score"), (3, None)], "k long, t string")
    found = [(r["k"], r["found"], r["superseded_by"], r["migration"], r["authority"]) for r in N.audit(texts, "k", "t", table).collect()]
    assert found == [(1, "alpha-1", "ALPHA-2", "Count again", "Board")]
    assert N.audit(texts, "k", "t", table.filter("id = 'norm:b'")).count() == 0
    hits = [(r["id"], r["score"]) for r in N.search(table, spark.createDataFrame([("stroke risk",)], "query string")).orderBy("rank").collect()]
    assert hits == [("norm:a", 5.0)]


def test_merge_titles(spark):
    rows = [note(1, "T", "short", ["b"], file="2.md", day=""), note(2, "T", "longest one", ["a", "b"], file="3.md"), note(3, "T", "longest two", file="1.md", day="2024-01-01"), note(4, None)]
    got = C.merge_titles(spark.createDataFrame(rows, NOTE)).first()
    assert (got["content"], got["tags"], got["sources"], got["observed_on"], got["members"]) == ("longest two", ["a", "b"], ["3", "1", "2"], "2024-01-01", 3)


def test_strength(spark):
    rows = [("c", 1, "t-1", "2024-02-01", "x", False), ("c", 1, "t-1", "2024-02-01", "x", False), ("c", 2, "t-1", "", "y", None), ("c", 3, "t-2", "2023-01-01", "z", True)]
    e = spark.createDataFrame(rows, "concept_id string, ord int, source string, observed_on string, detail string, contradicts boolean")
    got = C.strength(C.clean_evidence(e)).first()
    assert tuple(got) == ("c", 1, 1, "2023-01-01", "2024-02-01")
    concepts = spark.createDataFrame([("c",), ("d",)], "id string")
    assert tuple(C.compounding(C.strength(e), concepts).first()) == (2, 1, 0.5, 0, 2, 1)


def test_greedy_absorption_equals_one_by_one(spark):
    random.seed(8)
    for _ in range(3):
        ids = list(range(40))
        pairs = list({tuple(sorted(random.sample(ids, 2))) for _ in range(60)})
        place = dict(zip(ids, random.sample(ids, 40)))
        taken = {}
        for a in sorted(ids, key=place.get):
            if a in taken:
                continue
            for x, y in pairs:
                other = y if x == a else x if y == a else None
                if other is not None and other not in taken and not any(v == other for v in taken.values()):
                    taken[other] = a
        got = C.greedy_absorption(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, score double"), spark.createDataFrame(list(place.items()), "id long, place long"), 0.5)
        assert {r["absorbed"]: r["id"] for r in got.collect()} == taken
    assert C.greedy_absorption(spark.createDataFrame([], "a long, b long, score double"), spark.createDataFrame([(1, 1)], "id long, place long"), 0.5).count() == 0


def test_decide_budget_and_slugs(spark):
    best = spark.createDataFrame([("a", "x", 0.9), ("b", "y", 0.8), ("c", "z", 0.1), ("d", None, None)], "query string, doc string, score double")
    assert {r["query"]: (r["action"], r["target"]) for r in C.decide(best).collect()} == {"a": ("merge", "x"), "b": ("ambiguous", "y"), "c": ("create", None), "d": ("create", None)}
    assert {r["action"] for r in C.decide(best, "none").collect()} == {"merge", "link", "create"}
    def judge(query, target):
        if query == "e":
            raise RuntimeError("no answer")
        return target == "y"

    more = best.unionByName(spark.createDataFrame([("e", "y", 0.8), ("f", "z", 0.8)], best.schema))
    assert {r["query"]: r["action"] for r in C.settle(C.decide(more), judge).collect()} == {"a": "merge", "b": "merge", "c": "create", "d": "create", "e": "link", "f": "link"}
    blocks = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 1)], "g string, o int, t int")
    assert [r["o"] for r in C.within_budget(blocks, "g", "o", "t", 10).collect()] == [1]
    slugs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, s string")
    assert [r["slug"] for r in C.unique_slugs(slugs, "k", "s", "k").orderBy("k").collect()] == ["a", "a-2", "b"]


def test_absorb(spark):
    s = "id string, title string, content string, tags array<string>, aliases array<string>, links array<string>, applies_norm array<string>"
    base = spark.createDataFrame([("c", "T", "ab", ["x"], None, ["l"], [])], s)
    other = spark.createDataFrame([("c", "U", "abc", ["y", "x"], ["V", "T"], [], ["n"])], s)
    assert tuple(C.absorb(base, other).first()) == ("c", "T", "abc", ["x", "y"], ["U", "V"], ["l"], ["n"])


def test_absorb_takes_in_every_tied_note(spark):
    s = "id string, title string, content string, tags array<string>, aliases array<string>, links array<string>, applies_norm array<string>"
    base = [("c", "T", "ab", ["x"], None, ["l"], []), ("d", "D", "long enough", None, ["A"], None, None), ("e", "E", "none tied", [], [], [], [])]
    n = "note_id long, t long, title string, content string, tags array<string>, links array<string>, applies_norm array<string>"
    notes = [
        (1, 7, "U", "abc", ["y", "x"], [], ["n"]), (2, 7, "T", "abd", ["z", None, "y"], ["l", "m"], None), (3, 8, "A", None, None, None, ["n", "o"]),
        (4, 9, None, "abcd", ["w"], ["k"], []), (5, 9, "U", "abce", ["b"], None, None), (6, 6, "never", "x" * 99, ["never"], [], []),
    ]
    ties = [("c", 9), ("c", 7), ("c", 7), ("d", 8), ("d", 7), ("e", 5)]
    frame = spark.createDataFrame(base, s)
    got = C.absorb(frame, C.tied_notes(spark.createDataFrame(ties, "id string, t long"), spark.createDataFrame(notes, n)))
    want = {}
    for i, title, content, tags, aliases, links, norms in base:
        lists = [list(x or []) for x in (tags, aliases, links, norms)]
        taken = [x for x in notes if (i, x[1]) in ties]
        for _, _, u, c, g, k, m in taken:
            content = c if len(c or "") > len(content) else content
            for held, new in zip(lists, (g, [u], k, m)):
                held += [v for v in dict.fromkeys(new or []) if v is not None and v != (title if held is lists[1] else None) and v not in held]
        if taken:
            want[i] = (title, content, *lists)
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want and len(want) == 2


def test_markdown_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([note(1, "One title", "Text.\nMore text.", ["heart", "a-b"], ["Other", "Third one"])], NOTE)
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "1.md").write_text(markdown.note_markdown(rows).first()["value"], encoding="utf-8")
    (folder / "2.md").write_text("no title here", encoding="utf-8")
    got = markdown.read_notes(spark, str(folder)).collect()
    assert len(got) == 1
    assert (got[0]["title"], got[0]["content"], got[0]["tags"], got[0]["links"]) == ("One title", "Text.\nMore text.", ["heart", "a-b"], ["Other", "Third one"])
    e = spark.createDataFrame([("c", 1, "t-9", "2024-01-02", "it — rose", True), ("c", 2, "t-8", None, "", False)], "concept_id string, ord int, source string, observed_on string, detail string, contradicts boolean")
    back = {r["ord"]: (r["source"], r["observed_on"], r["detail"], r["contradicts"]) for r in markdown.parse_evidence(markdown.evidence_lines(e)).collect()}
    assert back == {1: ("t-9", "2024-01-02", "it — rose", True), 2: ("t-8", None, "", False)}


def test_sqlite_and_dump(spark, tmp_path):
    db = tmp_path / "a.sqlite"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE users (id, email)")
        c.execute("CREATE TABLE enc (id, created_at, transcription, clinical_note)")
        c.executemany("INSERT INTO enc VALUES (?, '2024', ?, ?)", [(1, "x" * 50, None), (2, "short", "n")])
    dump = tmp_path / "b.dump"
    dump.write_text("SET x;\nCOPY public.transcriptions (id, created_at, transcript, notes) FROM stdin;\n1\t2024\ta\\nb\\tc\t\\N\n2\t2024\tonly\n3\t2024\tz\tq\n\\.\n\nSELECT 1;\n", encoding="utf-8")
    assert [f["kind"] for f in dumps.discover(str(tmp_path))] == ["sqlite", "pgdump"] and dumps.discover(str(tmp_path / "none")) == []
    assert [t["table"] for t in dumps.sqlite_tables(str(db))] == ["enc"]
    rows = dumps.read_sqlite(spark, str(db), "enc")
    assert {tuple(r) for r in rows.collect()} == {("1", "x" * 50, ""), ("2", "short", "n")}
    assert [r["id"] for r in dumps.usable(rows).collect()] == ["1"]
    blocks = dumps.copy_blocks(spark, str(dump))
    first = blocks.first()
    assert first["table"] == "transcriptions" and first["columns"] == ["id", "created_at", "transcript", "notes"]
    assert {tuple(r) for r in dumps.encounters(blocks, first["columns"]).collect()} == {("1", "a\nb\tc", ""), ("3", "z", "q")}
    assert dumps.roles(["video", "transcript"]) == {"transcript": "transcript", "note": None, "id": "video"}


def test_checkpoint_lines(spark, tmp_path):
    p = tmp_path / "done.jsonl"
    p.write_text('{"record_id": "1", "status": "ok"}\nbroken\n{"record_id": "2", "status": "api_error"}\n', encoding="utf-8")
    assert [r["id"] for r in dumps.done_ids(spark, str(p)).collect()] == ["1"]


def test_distil(spark):
    rows = spark.createDataFrame([(1, "Ann has had a long and winding story of pain", "", [("name", "Ann")]), (2, "short", "", []), (3, "fails " * 12, "", [])], "id long, transcript string, notes string, pii_known array<struct<kind:string,value:string>>")

    def model(transcript, notes):
        if transcript.startswith("fails"):
            raise RuntimeError("no answer")
        return [{"title": "T", "kind": "pattern", "content": transcript, "tags": ["#A"]}, {"title": "U", "kind": "pattern", "content": "40 mg daily"}]

    good, bad = distill.distil(rows, model)
    got = good.collect()
    assert [(r["record"], r["title"], r["tags"]) for r in got] == [("1", "T", ["a"])] and "Ann" not in got[0]["content"]
    assert {(r["record"], r["errors"][0]) for r in bad.collect()} == {("1", "numeric claim"), ("3", "no answer")}


def test_search_and_compile(spark):
    rows = [note(1, "Heart failure", "swelling of legs uses alpha-1 always", links=["Salt intake"]), note(2, "Salt intake", "salt and swelling"), note(3, "Cold hands", "winter"), note(4, "Hub", "rest", links=["Heart failure"])]
    notes = spark.createDataFrame(rows, NOTE)
    asked = spark.createDataFrame([("q", "heart failure swelling")], "q string, text string")
    ordered = retrieve.search(notes, asked, "q", "text", 4)
    hits = [(r["doc"], r["score"]) for r in ordered.orderBy("rank").collect()]
    assert hits[0] == ("Heart failure", 1.0) and ("Hub", 0.45) in hits and all(t != "Cold hands" for t, _ in hits)
    once = retrieve.search(notes, asked, "q", "text", 4, in_order=False)
    assert {r["doc"] for r in once.collect()} == {t for t, _ in hits}
    out = compile_plan.compile_module("heart", ordered, C.last_by_title(notes), norms(spark), "2026-08-27")
    assert [c["found"] for c in out.corrections] == ["alpha-1"] and out.stale_norms == ["norm:a", "norm:b"]
    assert out.prompt.index("Superseded") < out.prompt.index("### ")
    small = compile_plan.compile_module("heart", ordered, C.last_by_title(notes), norms(spark), "2026-08-27", max_tokens=60)
    assert len(small.concepts) < len(out.concepts) and small.corrections == out.corrections


def test_relaxation_runs_in_order():
    scores = {"a": 1.0, "b": 0.1, "c": 0.05}
    out = retrieve._relax(scores, ["a", "b"], {"a": ["b"], "b": ["c"]}, 1, 0.45)
    assert out == {"a": 1.0, "b": 0.45, "c": 0.2025}


def test_context(spark):
    rows = [({" Age": "60", "meds": "", "GOAL ": "help"},), ({},), (None,)]
    df = spark.createDataFrame(rows, "m map<string,string>").select(api.missing_context(F.col("m")).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got[0] == ["duration", "meds", "workup"] and got[1] == list(api.CONTEXT_KEYS)


def test_api(spark, data):
    k = api.Knowledge(spark, data, "2026-08-31")
    assert k.session_brief({"age": 4, "meds": ""})["missing"] == ["duration", "meds", "workup", "goal"]
    title = k.notes.filter("title IS NOT NULL").orderBy("note_id").first()["title"]
    assert k.search(title, 3).filter(F.col("doc") == title).count() == 1
    assert k.get_note(title).count() == 1
    module = k.compile(title, 500, 5, {"age": "1"})
    assert module.estimated_tokens > 0 and module.extra["ask_next"][0] == "duration"
    assert k.norm_lookup("norm:velmar").first()["found_by"] == "id"
    assert k.concept_compounding().first()["concepts"] == 240
    assert k.graph_stats().first()["nodes"] > 0 and k.stale_norms().count() > 0
    ids = [r["id"] for r in k.concepts.limit(2).collect()]
    merged, told = k.concept_merge(*ids)
    assert merged.count() == 1 and told.count() > 0 and k.concept_merge(ids[0], ids[0])[0].count() == 0


def test_streams(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/evidence.parquet")
    folder = tmp_path / "in"
    source.limit(200).coalesce(1).write.parquet(str(folder))
    stream = ingest.evidence_stream(spark, str(folder), source.schema)
    seen = []
    ingest.run_batches(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c1")).awaitTermination(120)
    assert sum(seen) == 200
    q = ingest.daily_counts(stream, "1 day").writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(observations) FROM daily").first()[0] > 0
