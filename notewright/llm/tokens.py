"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Short texts are encoded as they are, a batch at a time. A long text is cut into leaves that Spark
encodes in parallel; a tree of joins then puts neighbours together. A join re-encodes a growing
window around the cut until the new encoding agrees with both sides, so the result equals the
encoding of the whole text exactly, wherever the cuts fell.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from notewright.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Code points of a leaf; texts up to this length are encoded in one piece.
LEAF_CHARS = 4096
#: Fixed value: the split pattern that belongs to the published vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece is settled if it ends so many characters before the end of what was seen:
#: the pattern looks at most two characters past the end of a match.
LOOKAHEAD = 3
GIANT_BYTES = 1024


class Bpe:
    """A tokenizer of a worker process: whole texts, single pieces, and exact joins."""

    def __init__(self, folder: str, name: str):
        import regex
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.piece = self.encoding._core_bpe.encode_single_piece

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def leaf(self, text: str) -> list[int]:
        """Ids in order; the first id of each piece is stored as ``~id`` to mark where it begins."""
        out: list[int] = []
        for piece in self.pieces(text):
            self._add(out, self.piece(piece.encode()))
        return out

    @staticmethod
    def _add(out: list[int], ids: list[int]) -> None:
        out.append(~ids[0])
        out.extend(ids[1:])

    def text_of(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[~i if i < 0 else i] for i in ids)

    def merge_piece(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of one unsplit piece from those of its two parts, by a growing window of tokens.

        A token sequence is the BPE encoding of its text if each two neighbours are the encoding of
        theirs. Inside the window that holds by construction, outside because both parts are
        encodings, and at the edges as soon as the window begins and ends with the old tokens.
        """
        w = 8
        while True:
            left, right = a[-w:], b[:w]
            ids = self.piece(self.text_of(left + right))
            whole_a, whole_b = w >= len(a), w >= len(b)
            if (whole_a or ids[:2] == left[:2]) and (whole_b or ids[-2:] == right[-2:]):
                return a[: len(a) - len(left)] + ids + b[len(right) :]
            w *= 2

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Marked ids of the concatenated text from the marked ids of its two parts."""
        if not left or not right:
            return left or right
        l_starts = [i for i, x in enumerate(left) if x < 0]
        r_starts = [i for i, x in enumerate(right) if x < 0]
        k = 4
        while True:
            i = l_starts[-k] if k < len(l_starts) else 0
            last = k >= len(r_starts)
            j = len(right) if last else r_starts[k]
            head, tail = self.text_of(left[i:]), self.text_of(right[:j])
            window = (head + tail).decode()
            settled = len(window) if last else len(window) - LOOKAHEAD
            own, at = {}, len(head)  # byte offset in the window -> index in right, where right's own pieces begin
            for n, x in enumerate(right[:j]):
                if x < 0:
                    own[at] = n
                at += len(self.bytes_of[~x if x < 0 else x])
            if last:
                own[at] = j
            out, at, chars, agreed = left[:i], 0, 0, None
            for piece in self.pieces(window):
                if at in own and chars <= settled:
                    agreed = own[at]
                    break
                raw = piece.encode()
                if at < len(head) < at + len(raw) and len(raw) > GIANT_BYTES:
                    a, b = left[l_starts[-1] :], right[: r_starts[1] if len(r_starts) > 1 else len(right)]
                    a, b = [~a[0], *a[1:]], [~b[0], *b[1:]]
                    fits = len(self.text_of(a)) == len(head) - at and len(self.text_of(b)) == at + len(raw) - len(head)
                    self._add(out, self.merge_piece(a, b) if fits else self.piece(raw))
                else:
                    self._add(out, self.piece(raw))
                at += len(raw)
                chars += len(piece)
            if agreed is None and at in own:
                agreed = own[at] if chars <= settled else None
            if agreed is not None:
                return out + right[agreed:]
            k *= 4


@lru_cache(maxsize=4)
def bpe(folder: str, name: str) -> Bpe:
    return Bpe(folder, name)


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


#: Texts and ids that one Arrow batch of the result may hold, so that many long texts make many batches.
BATCH_IDS = 1 << 20


def _batches(keys: list[pa.Array], made: Iterator[list[int]]) -> Iterator[pa.RecordBatch]:
    first, some, total = 0, [], 0
    names = [f"k{n}" for n in range(len(keys))] + ["ids"]
    for ids in made:
        some.append(ids)
        total += len(ids)
        if total >= BATCH_IDS:
            yield pa.RecordBatch.from_arrays([*(k.slice(first, len(some)) for k in keys), _lists(some)], names=names)
            first, some, total = first + len(some), [], 0
    if some:
        yield pa.RecordBatch.from_arrays([*(k.slice(first, len(some)) for k in keys), _lists(some)], names=names)


def encode_corpus(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer_dir: str = TOKENIZER_DIR,
    tokenizer: str = TOKENIZER,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """(key, ids array<int>): the token ids of each text, without special tokens, one row per input row.

    Defined cases: a null and an empty text give an empty list; strings that look like special
    tokens are ordinary text; rows with equal keys each come out (a long text's leaves are told
    apart by a row number made before the split, so repeated keys never mix); null keys stay;
    other columns are not read; an empty table gives an empty result. Texts over ``leaf_chars`` code
    points are split, encoded in parallel and joined in a tree, with the same result at any length.
    """
    rows = spread(documents.select(F.col(key).alias("k0"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = rows.schema["k0"].dataType
    id_list = T.ArrayType(T.IntegerType())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(tokenizer_dir, tokenizer).encode
        for batch in batches:
            yield from _batches([batch.column(0)], (encode(t.as_py()) for t in batch.column(1)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(tokenizer_dir, tokenizer).leaf
        for batch in batches:
            yield from _batches(batch.columns[:3], (encode(t.as_py()) for t in batch.column(3)))

    def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = bpe(tokenizer_dir, tokenizer).join
        for batch in batches:
            pairs = zip(batch.column(3), batch.column(4))
            yield from _batches(batch.columns[:3], (join(a.as_py() or [], b.as_py() or []) for a, b in pairs))

    short = rows.filter(F.length("text") <= leaf_chars).mapInArrow(whole, T.StructType([T.StructField("k0", kind), T.StructField("ids", id_list)]))
    long = rows.filter(F.length("text") > leaf_chars)
    longest = long.agg(F.max(F.length("text"))).first()[0]
    if longest is None:
        return short.withColumnRenamed("k0", key)
    levels = (-(-longest // leaf_chars) - 1).bit_length()
    shape = T.StructType([T.StructField("k0", kind), T.StructField("k1", T.StringType()), T.StructField("k2", T.IntegerType()), T.StructField("ids", id_list)])
    cuts = F.expr(f"regexp_extract_all(text, '(?s).{{1,{leaf_chars}}}', 0)")
    # equal (key, text) rows get equal ids, so one tree serves them; their number comes back at the end
    counted = long.groupBy("k0", F.sha2("text", 256).alias("k1")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    parts = counted.select("k0", "k1", F.posexplode(cuts).alias("k2", "part"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = parts.repartition(n, "k0", "k1", "k2").mapInArrow(leaves, shape)
    for _ in range(levels):
        side = F.col("k2") % 2
        pairs = nodes.groupBy("k0", "k1", F.floor(F.col("k2") / 2).cast("int").alias("half")).agg(
            F.max(F.when(side == 0, F.col("ids"))).alias("a"), F.max(F.when(side == 1, F.col("ids"))).alias("b")
        )
        nodes = pairs.select("k0", "k1", F.col("half").alias("k2"), "a", "b").mapInArrow(joins, shape)
    unmark = F.transform("ids", lambda i: F.when(i < 0, F.bitwise_not(i)).otherwise(i))
    times = counted.select(F.col("k0").alias("q0"), F.col("k1").alias("q1"), "times")
    done = nodes.join(times, F.col("k0").eqNullSafe(F.col("q0")) & (F.col("k1") == F.col("q1")))
    done = done.select("k0", unmark.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("k0", "ids")
    return short.unionByName(done).withColumnRenamed("k0", key)
