import random

import pytest
from pyspark.sql import functions as F

from notewright.llm import tokens as K

bpe = K.bpe(K.TOKENIZER_DIR, K.TOKENIZER)


def tree(text, n):
    parts = [bpe.leaf(text[i : i + n]) for i in range(0, len(text), n)]
    while len(parts) > 1:
        parts = [bpe.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return [~x if x < 0 else x for x in (parts[0] if parts else [])]


def test_joins_at_any_cut():
    random.seed(7)
    pieces = ["a", "b", "'", "l", "ll", " ", "  ", "\n", "1", "é", "😀", "!", "the", "re", "\t", "å", "́", "‍", "'s", "!!!!", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(random.choices(pieces, k=random.randint(0, 50)))
        assert tree(text, random.randint(1, 9)) == bpe.encode(text), repr(text)


@pytest.mark.parametrize("text", ["ab" * 4000, "abcdefghij" * 900 + " " * 3000 + "x", "".join(random.Random(1).choices("etaoinå", k=9000)), "é" * 5000 + "'ll"])
def test_unsplit_runs(text):
    for n in (500, 1700, 4096):
        assert tree(text, n) == bpe.encode(text)


def test_agrees_with_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.TOKENIZER_DIR}/{K.TOKENIZER}.json")
    t.encode_special_tokens = True
    for text in ("Hello  world's", "år 2024\r\n​", "<|endoftext|>", ""):
        assert bpe.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_corpus(spark):
    texts = [None, "", " ", "short one", "word " * 300, "x" * 1000, "x" * 1000, "ends here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "short one"), (None, "key"), (5, "x" * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("k1", F.lit(1))
    got = sorted((str(r["doc_id"]), r["ids"]) for r in K.encode_corpus(df, leaf_chars=64).collect())
    assert got == sorted((str(k), bpe.encode(t or "")) for k, t in rows)
    assert bpe.encoding.decode(bpe.encode("åäö 😀")) == "åäö 😀"
    assert K.encode_corpus(df.limit(0)).count() == 0
