"""Dumps, SQLite files, vault files and sinks."""

import json
import os
import sqlite3

from pyspark.sql import functions as F

from notewright.operators import concepts as C
from notewright.plans import distill
from notewright.plans.api import Knowledge
from notewright.session import table
from notewright.sources import dumps, vault

DUMP = (
    "SET x = 0;\nCOPY public.encounters (id, day, transcript, notes) FROM stdin;\n"
    "31\t2024-06-01\tPressure in both arms.\\nDoctor: since when does it hurt there?\tUnclear.\n"
    "32\t2024-06-11\tThey said\\t(a tab inside)\\tthat it comes at night, every night.\tNightly.\n"
    "33\t2024-07-02\t\\N\tnothing was said\n34\t2024-07-03\ttoo few fields\n\\.\n\n"
    "COPY public.users (id, email) FROM stdin;\n1\tx@y.example\n\\.\n"
)


def folder(tmp_path):
    with sqlite3.connect(tmp_path / "clinic.db") as c:
        c.execute("CREATE TABLE users (id INTEGER, email TEXT)")
        c.execute("CREATE TABLE visits (id INTEGER PRIMARY KEY, created_at TEXT, transcription TEXT, clinical_note TEXT)")
        c.executemany("INSERT INTO visits VALUES (?, ?, ?, ?)", [(7, "2024", "Patient: it beats too fast, and then it stops for a while.", "SVE."), (9_000_000_000, "2024", "short", "skipped")])
        c.execute("CREATE VIEW recent AS SELECT id, transcription FROM visits WHERE id < 8")
        c.execute("CREATE TABLE empty_one (pk INTEGER, raw TEXT, conclusion TEXT)")
        c.execute("CREATE TABLE keyed (visit_id TEXT PRIMARY KEY, dialogue TEXT) WITHOUT ROWID")
        c.execute("INSERT INTO keyed VALUES ('k', ?)", ("z" * 60,))
        c.execute("CREATE VIEW broken AS SELECT transcript FROM no_such_table")
    (tmp_path / "old.dump").write_text(DUMP, encoding="utf-8")
    (tmp_path / "other.txt").write_text("nothing")
    return str(tmp_path)


def test_sources_of_a_folder(spark, tmp_path):
    found = dumps.sources(spark, folder(tmp_path))
    assert [(s["kind"], s["table"]) for s in found] == [("sqlite", "visits"), ("sqlite", "empty_one"), ("sqlite", "keyed"), ("sqlite", "recent"), ("pgdump", "encounters")]
    assert found[0]["roles"] == {"transcript": "transcription", "note": "clinical_note", "id": "id"}
    assert found[1]["roles"] == {"transcript": "raw", "note": "conclusion", "id": "pk"}
    assert dumps.roles(["visit_id", "conversation", "journal"]) == {"transcript": "conversation", "note": "journal", "id": "visit_id"}
    read = {s["table"]: {tuple(r) for r in dumps.read_source(spark, s).collect()} for s in found}
    assert read["empty_one"] == set() and read["keyed"] == {("k", "z" * 60, "")} and {r[0] for r in read["recent"]} == {"7"}
    assert {r[0] for r in read["visits"]} == {"7", "9000000000"}
    assert {r[0]: r[1:] for r in read["encounters"]} == {
        "31": ("Pressure in both arms.\nDoctor: since when does it hurt there?", "Unclear."), "32": ("They said\t(a tab inside)\tthat it comes at night, every night.", "Nightly."), "33": ("", "nothing was said"),
    }
    assert dumps.sources(spark, str(tmp_path / "none")) == []


def test_dump_by_ranges_of_bytes(spark, tmp_path):
    p = tmp_path / "a.sql"
    p.write_bytes((DUMP.replace("night, every", "nätt 😀, every") + "COPY t (id, body) FROM stdin;\r\n5\tlast\r\n").encode())
    whole = {(r["table"], tuple(r["fields"])) for r in dumps.copy_blocks(spark, str(p)).collect()}
    assert len(whole) == 6 and ("t", ("5", "last")) in whole
    for width in (17, 64):
        assert {(r["table"], tuple(r["fields"])) for r in dumps.copy_blocks(spark, str(p), width=width).collect()} == whole
    gap = tmp_path / "gap.sql"
    gap.write_text("COPY t (id, body) FROM stdin;\n1\ta\n\n2\tb\n\\.\n3\tc\n")
    assert [r["fields"][0] for r in dumps.copy_blocks(spark, str(gap)).collect()] == ["1"]
    assert [r["fields"][0] for r in dumps.copy_blocks(spark, str(gap), blank_ends=False).orderBy("at").collect()] == ["1", "2"]
    empty = tmp_path / "empty.sql"
    empty.write_text("")
    assert dumps.copy_blocks(spark, str(empty)).count() == 0


def test_pages(spark, tmp_path, data):
    where, k = folder(tmp_path), Knowledge(spark, data, "2026-08-31")
    assert [s["table"] for s in k.source_discover(where)][-1] == "encounters"
    assert [r["id"] for r in k.source_read(where).collect()] == ["7"]
    assert [r["id"] for r in k.source_read(where, "old.dump", 1, 1).collect()] == ["32"]
    title = table(spark, data, "notes").filter("title IS NOT NULL").first()["title"]
    assert title in {r["title"] for r in k.titles_with(title[2:9].upper()).collect()}


def test_flat_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: A\ntags: [#x, #y-z]\napplies_norm: [norm:a, norm:b]\nsource: s: 1\n---\n\nContent: One\ntwo\nLinks:\n- [[B c]]\n- [[D]]\n")
    (tmp_path / "b.md").write_text("---\ntitle: A\nkind: norm\n---\nno content line\n")
    (tmp_path / "c.md").write_text("title: C\nContent: no head\n")
    (tmp_path / "d.md").write_text("---\nkind: norm\n---\nContent: no title\n")
    got = {r["file_name"]: r for r in vault.read_flat(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.md"}
    a = got["a.md"]
    assert (a["title"], a["kind"], a["source"], a["tags"], a["applies_norm"], a["content"], a["links"]) == ("A", "pattern", "s: 1", ["x", "y-z"], ["norm:a", "norm:b"], "One\ntwo", ["B c", "D"])
    assert (got["b.md"]["kind"], got["b.md"]["content"], got["b.md"]["source"]) == ("norm", "", "unknown")


def test_concept_files(spark, tmp_path, data):
    concepts = table(spark, data, "concepts").limit(30)
    evidence = C.clean_evidence(table(spark, data, "evidence")).join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    vault.write_concepts(concepts, evidence, str(tmp_path / "out"))
    back, told = vault.read_concepts(spark, str(tmp_path / "out"))
    rows = {r["id"]: r for r in concepts.collect()}
    got = {r["id"]: r for r in back.collect()}
    assert set(got) == set(rows)
    for k, r in rows.items():
        for c in ("tags", "aliases", "links", "applies_norm"):
            assert got[k][c] == [v for v in r[c] or [] if v is not None], (k, c)
        assert got[k]["title"] == (r["title"] or k)
    assert told.count() > 0.9 * evidence.count()
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "odd one.md").write_text("---\ntitle: [unclosed\n---\nText\n\n## Other\nlost\n\n## Evidence (1)\n\n- [[t-1]] 2024-01-02 — seen\n\n## Links\n\n[[A]], [[B]]\n")
    one, seen = vault.read_concepts(spark, str(tmp_path / "md"))
    r = one.first()
    assert (r["id"], r["title"], r["content"], r["links"]) == ("odd-one", "odd one", "Text", ["A", "B"])
    assert [tuple(x)[2:4] for x in seen.collect()] == [("t-1", "2024-01-02")]


def test_norm_files(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("id: norm:b\ncurrent: B\nlast_verified: 2024-05-06\nthresholds: {treat: '>=2'}\nsupersedes:\n  - {name: OLD-B, until: '2020-01-01', migration: recount}\n")
    (tmp_path / "a.yml").write_text("id: norm:a\naliases: [x, y]\nvalid_from: soon\n")
    got = {r["id"]: r for r in vault.read_norms(spark, str(tmp_path)).collect()}
    assert (got["norm:a"]["ord"], got["norm:b"]["ord"]) == (0, 1) and got["norm:a"]["volatility"] == "12mo" and got["norm:a"]["valid_from"] is None and got["norm:a"]["aliases"] == ["x", "y"]
    b = got["norm:b"]
    assert str(b["last_verified"]) == "2024-05-06" and b["thresholds"] == {"treat": ">=2"} and str(b["supersedes"][0]["until"]) == "2020-01-01"


def test_snapshot_and_manifest(spark, tmp_path):
    notes = spark.createDataFrame([("T", "b.md", "long content", ["x"], None, "1", "", 1), ("T", "a.md", "c", ["y"], ["n"], "2", "2024", 2), ("U", "c.md", None, None, None, None, None, 3)], "title string, file_name string, content string, tags array<string>, applies_norm array<string>, source_transcript string, observed_on string, note_id long")
    links = spark.createDataFrame([("T", "U"), ("U", "T")], "src string, dst string")
    vault.write_consolidated(C.merge_titles(notes), notes, links, str(tmp_path / "s"))
    rows = {r["title"]: r for r in spark.read.parquet(str(tmp_path / "s/notes")).collect()}
    assert rows["T"]["tags"] == ["x", "y"] and rows["T"]["links"] == ["U"] and rows["U"]["tags"] == []
    listed = {r["title"]: r for r in spark.read.json(str(tmp_path / "s/manifest")).collect()}
    assert (listed["T"]["file_name"], listed["T"]["merged_from"], listed["U"]["merged_from"]) == ("a.md", ["b.md"], [])


def test_batches_resume(spark, tmp_path):
    schema = "id long, transcript string, notes string, pii_known array<struct<kind:string,value:string>>"
    rows = spark.createDataFrame([(1, "good " * 12, "", []), (2, "x", "", []), (3, "fails " * 12, "", []), (4, "states 40 mg " * 6, "", [])], schema)
    calls = tmp_path / "calls"
    calls.mkdir()
    broken = [True]

    def model(fails):
        def run(transcript, notes):
            (calls / f"{os.getpid()}-{len(os.listdir(calls))}").write_text("")
            if fails and transcript.startswith("fails"):
                raise RuntimeError("no answer")
            return [{"title": "T", "kind": "pattern", "content": "40 mg daily" if "40 mg" in transcript else transcript}]

        return run

    where = str(tmp_path / "state")
    assert broken and tuple(distill.run_batch(rows, model(True), where).first()) == (3, 1, 1, 1, 1, 1, 1)
    assert len(os.listdir(calls)) == 3
    again = distill.run_batch(rows, model(False), where).first()
    assert (again["processed"], again["ok"], again["quarantined"], again["api_error"]) == (2, 1, 1, 0)
    assert spark.read.parquet(where + "/notes").count() == 2
    dumps.write_prepared(rows.withColumn("date", F.lit("2024")), str(tmp_path / "prepared"))
    assert dumps.read_prepared(spark, str(tmp_path / "prepared")).count() == 4
    lines = [json.loads(x) for f in os.listdir(where + "/checkpoint") if f.endswith(".json") for x in open(f"{where}/checkpoint/{f}")]
    assert {x["record_id"] for x in lines} == {"1", "2", "3", "4"}
