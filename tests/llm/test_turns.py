from pyspark.sql import functions as F

from notewright.llm import turns as T


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, transcription string").withColumn("line", F.lit(1)).withColumn("text", F.lit("clash")).withColumn("key", F.lit(2))
    out = {}
    for r in T.speaker_turns(df).orderBy("id", "turn_no").collect():
        out.setdefault(r["id"], []).append((r["speaker"], r["text"], r["n_words"]))
    return out


def test_layouts(spark):
    texts = [
        "1\n00:00:04,000 --> 00:00:05,000\nDoctor : Hello [beep] there.\n\n2\n00:00:01,000 --> 00:00:02,000\nPat.: First\nof all.\n",
        "[0:07] Dr Åkerlund> Two things: um, sit\n    up.\n[0:03] nurse> At 8:10 (really fine).",
        "Speakers: S1 = Läkare; S2 is Pt\nS2: Hej\nS1: er... Tar ni er medicin?\nS3: Vad?",
        "Just talk. Patient: yes Doctor: Two things: no. D: er,",
        "**P** : 49 mm mm, on the trace mmm...\\n**RN**: The ER er, said (laughter) *sighs* so.\\n**P**: [00:00:09] (long\\nsilence)",
        "Mrs Vik 00:00:02.5: a\nTolk 00:00:01.5: b <00:00:03> c\nMor 00:00:03.5: d",
        "54.4s plain\n12:15 and I sat up.",
    ]
    got = run(spark, texts)
    assert got[0] == [("patient", "First of all.", 3), ("doctor", "Hello there.", 2)]
    assert got[1] == [("nurse", "At 8:10 (really fine).", 4), ("doctor", "Two things: sit up.", 4)]
    assert got[2] == [("patient", "Hej", 1), ("doctor", "Tar ni er medicin?", 4), ("unknown", "Vad?", 1)]
    assert got[3] == [("unknown", "Just talk.", 2), ("patient", "yes", 1), ("doctor", "Two things: no.", 3)]
    assert got[4] == [("patient", "49 mm on the trace", 5), ("nurse", "The ER said so.", 4)]
    assert got[5] == [("interpreter", "b c", 2), ("patient", "a", 1), ("relative", "d", 1)]
    assert got[6] == [("unknown", "54.4s plain 12:15 and I sat up.", 7)]


def test_defined_cases(spark):
    texts = [None, "", " \n ", "[beep]", "Doctor: um,", "x " * 100_000]
    got = run(spark, texts)
    assert set(got) == {5} and got[5][0][2] == 100_000
    twice = spark.createDataFrame([(1, "P: a"), (1, "P: a"), (None, "P: b")], "id long, transcription string")
    assert {tuple(r)[:3] for r in T.speaker_turns(twice).collect()} == {(1, 1, "patient"), (None, 1, "patient")}
    assert T.speaker_turns(twice.limit(0)).count() == 0


def test_equal_times_keep_the_written_order(spark):
    got = run(spark, ["[0:01] P: a\n[0:01] D: b\n[0:00] N: c", "[0:05] P: a\nD: b\n[0:01] N: c"])
    assert [t[1] for t in got[0]] == ["c", "a", "b"] and [t[1] for t in got[1]] == ["a", "b", "c"]
