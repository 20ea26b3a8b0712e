"""Long spans shared between records: seeds, collinear chains, aligned passages.

Equal texts are one record. Of every text the k-mers that are least in a window are kept as seeds
(winnowing), so two texts that share ``span`` characters share a seed inside that span. Seeds that
two texts have are joined to anchors; the anchors of a pair are chained in order with gap costs,
with a Fenwick tree of prefix maxima, and no anchor is lost: what the best chain leaves begins
another one. Chains are aligned on the texts: the maximal runs of equal characters in them are the
shared spans, chains with their gaps aligned are the fuzzy passages.

A seed that many texts have is not joined pairwise: its occurrences are tied to one of them (a
star). What they share with that hub comes from the chains. Windows round such a seed that differ
from the hub's may still be equal to one another; these, and no others, are compared by their
hashes, grouped over all texts, and each group of equal windows gets a hub of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from notewright.session import cut, spread

SPAN = 200
#: Seeds of the exact spans, and the shorter ones of the fuzzy passages.
K, FUZZY_K = 96, 64
#: Seeds with more occurrences are tied as a star instead of pairwise.
PAIRWISE = 12
#: Cost of a skipped character in a chain, in matched characters.
GAP_COST = 0.05
#: Code points that are hashed at once; longer texts are hashed in overlapping pieces.
PIECE = 1 << 18
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_ORDER_BITS = np.uint64(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def window_hashes(codes: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``length`` code points, from those of runs of powers of two."""
    n = len(codes)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    power, size = base, 1
    level = _mixed(codes + base)
    out, done = np.zeros(n - length + 1, dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while size <= length:
            if length & size:
                out = out * power + level[done : done + n - length + 1]
                done += size
            level = level[:-size] * power + level[size:] if len(level) > size else level[:0]
            power, size = power * power, size * 2
    return _mixed(out)


def _least_of_windows(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` hashes the place of its least one, the last of equal ones."""
    at = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes & ~_ORDER_BITS) | (_ORDER_BITS - (at & _ORDER_BITS))
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    return (_ORDER_BITS - (least & _ORDER_BITS)).astype(np.int64)


def seed_positions(codes: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): in each window of ``span - k + 1`` k-mers the least, the last of equal ones."""
    hashes = window_hashes(codes, k, _BASES[0])
    if len(codes) < span:
        return np.zeros(0, dtype=np.int64), hashes[:0]
    chosen = np.unique(_least_of_windows(hashes, span - k + 1))
    return chosen, hashes[chosen]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _pieces(docs: list[int], texts: pa.Array, span: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Groups of (documents, offsets, texts) of about ``PIECE`` code points; pieces of one text overlap by ``span - 1``."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for doc, text in zip(docs, texts):
        text = text.as_py()
        for at in range(0, max(len(text) - span + 1, 0), PIECE):
            part = text[at : at + PIECE + span - 1] if len(text) > PIECE else text
            for column, value in zip(held, (doc, at, part)):
                column.append(value)
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


def _seed_batches(span: int, k: int):
    """Seeds of many texts at once: they are hashed as one run, windows across two texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, offsets, texts in _pieces(batch.column(0).to_pylist(), batch.column(1), span):
                codes = points("".join(texts))
                sizes = np.array([len(t) for t in texts])
                starts = np.cumsum(sizes) - sizes
                hashes = window_hashes(codes, k, _BASES[0])
                least = _least_of_windows(hashes, span - k + 1)
                owner = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
                inside = np.arange(len(least)) + span <= (starts + sizes)[owner]
                chosen = np.unique(least[inside])
                of = np.searchsorted(starts, chosen, side="right") - 1
                pos = chosen - starts[of] + np.array(offsets)[of]
                yield pa.RecordBatch.from_arrays([_long(np.array(docs, dtype=np.int64)[of]), pa.array(pos.astype(np.int32)), _long(hashes[chosen])], names=["doc", "pos", "h"])

    return run


def chain(pa_: np.ndarray, pb: np.ndarray, k: int = K, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Chains of anchors (indices), best first: positions rise in both texts, gaps cost.

    A Fenwick tree over the ranks of the positions in b holds prefix maxima of score plus the cost
    of the way from the origin, so the best predecessor of an anchor costs a logarithm. Every anchor
    is in exactly one chain.
    """
    if len(pa_) == 1:
        return [[0]]
    order = np.lexsort((-pb, pa_))
    ranks = np.searchsorted(np.unique(pb), pb) + 1
    size = int(ranks.max()) if len(ranks) else 0
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, parent = [0.0] * len(pa_), [-1] * len(pa_)
    waiting: list[int] = []
    last = -1

    def put(i: int) -> None:
        item, r = (score[i] + gap_cost * (int(pa_[i]) + int(pb[i])), i), int(ranks[i])
        while r <= size:
            if tree[r][0] < item[0]:
                tree[r] = item
            r += r & -r

    for i in order:
        i = int(i)
        if pa_[i] != last:  # anchors at one position of a cannot precede one another
            for j in waiting:
                put(j)
            waiting, last = [], pa_[i]
        best, r = (-np.inf, -1), int(ranks[i]) - 1
        while r > 0:
            if tree[r][0] > best[0]:
                best = tree[r]
            r -= r & -r
        j = best[1]
        # overlapping anchors match no more than the new characters
        gain = k if j < 0 else min(k, int(pa_[i]) - int(pa_[j]), int(pb[i]) - int(pb[j]))
        linked = gain + best[0] - gap_cost * (int(pa_[i]) + int(pb[i])) if j >= 0 else -np.inf
        score[i], parent[i] = (linked, j) if linked > k else (float(k), -1)
        waiting.append(i)
    used = [False] * len(pa_)
    chains = []
    for i in sorted(range(len(pa_)), key=lambda x: -score[x]):
        if used[i]:
            continue
        path, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = parent[j]
        chains.append(path[::-1])
    return chains


_CHAINS = "a long, b long, chain int, anchors int, a_at array<int>, b_at array<int>, star array<boolean>"


def _chain_batches(k: int, gap_cost: float):
    """Anchors come sorted by (a, b); a pair that a batch cuts is carried on to the next."""

    def of_pairs(df: pd.DataFrame) -> pd.DataFrame:
        a, b, pa_, pb, star = (df[c].to_numpy() for c in ("a", "b", "pa", "pb", "star"))
        edges = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True]) if len(a) else np.zeros(1, dtype=int)
        rows = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            for n, path in enumerate(chain(pa_[lo:hi], pb[lo:hi], k, gap_cost)):
                rows.append((a[lo], b[lo], n, len(path), pa_[lo:hi][path], pb[lo:hi][path], star[lo:hi][path]))
        return pd.DataFrame(rows, columns=["a", "b", "chain", "anchors", "a_at", "b_at", "star"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for df in frames:
            df = df if held is None else pd.concat([held, df], ignore_index=True)
            if not len(df):
                continue
            open_pair = (df["a"] == df["a"].iloc[-1]) & (df["b"] == df["b"].iloc[-1])
            held, ready = df[open_pair], df[~open_pair]
            if len(ready):
                yield of_pairs(ready)
        if held is not None and len(held):
            yield of_pairs(held)

    return run


def text_classes(documents: DataFrame, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc, rep, copies, length), (texts: rep, text) of texts with ``span`` code points or more."""
    rows = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter((F.length("text") >= span) & F.col("doc").isNotNull())
    marks = rows.select("doc", F.sha2("text", 256).alias("mark"), F.length("text").alias("length"))
    reps = marks.groupBy("mark").agg(F.min("doc").alias("rep"), F.count_distinct("doc").alias("copies"), F.first("length").alias("length"))
    members = marks.select("doc", "mark").distinct().join(reps, "mark").select("doc", "rep", "copies", "length")
    # texts come spread by their key and stay where they are; only keys are moved
    texts = rows.join(reps.select("rep").distinct(), F.col("doc") == F.col("rep"), "left_semi").dropDuplicates(["doc"])
    return members, texts.select(F.col("doc").alias("rep"), "text")


def seeds_of(texts: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(doc, pos, h): the seeds of each text; at the ends of pieces of a long text a seed may come twice."""
    return texts.select("rep", "text").mapInArrow(_seed_batches(span, k), "doc long, pos int, h long")


def shared_anchors(seeds: DataFrame, pairwise: int = PAIRWISE) -> tuple[DataFrame, DataFrame]:
    """(a, b, pa, pb, star): seeds that two texts share, a < b, and (doc, pos): occurrences that no star settles.

    Frequent seeds are tied to their first occurrence, the hub, if they are in other texts. A hub's
    text that has its seed again is no measure of what others share with it: then all occurrences
    of the seed are left to the comparison of windows.
    """
    counted = seeds.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("hub"), F.max("doc").alias("far")).filter("hub <> far")
    held = cut(seeds.join(counted.select("h", "n", "hub"), "h"))
    few = held.filter(F.col("n") <= pairwise).select("h", "doc", "pos")
    left, right = few.select("h", F.col("doc").alias("a"), F.col("pos").alias("pa")), few.select("h", F.col("doc").alias("b"), F.col("pos").alias("pb"))
    pairs = left.join(right, "h").filter("a < b").select("a", "b", "pa", "pb", F.lit(False).alias("star"))
    many = held.filter(F.col("n") > pairwise)
    hubs = many.filter("doc = hub").groupBy("h").agg(F.min("pos").alias("at"), (F.min("pos") < F.max("pos")).alias("again"))
    many = many.join(hubs, "h")
    star = many.filter("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b"), F.col("at").alias("pa"), F.col("pos").alias("pb"), (~F.col("again")).alias("star"))
    return pairs.unionByName(star), many.filter("again").select("doc", "pos")


def chains(anchors: DataFrame, k: int = K, gap_cost: float = GAP_COST) -> DataFrame:
    """(a, b, chain, anchors, a_at, b_at, star): the chains of each pair, best first."""
    spread_out = spread(anchors, "a", "b").sortWithinPartitions("a", "b", "pa", "pb")
    return spread_out.mapInPandas(_chain_batches(k, gap_cost), _CHAINS)


def _with_texts(linked: DataFrame, texts: DataFrame, span: int, k: int) -> DataFrame:
    """Chains with the parts ``ta`` and ``tb`` of their texts, ``span`` characters to either side."""
    part = lambda c, at: F.expr(f"substring({c}, greatest({at}[0] - {span}, 0) + 1, element_at({at}, -1) - greatest({at}[0] - {span}, 0) + {k + span})")
    with_a = linked.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").withColumn("ta", part("ta", "a_at"))
    return with_a.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").withColumn("tb", part("tb", "b_at"))


def _common(a: str, b: str) -> int:
    """The length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def runs(ta: str, tb: str, x: list[int], y: list[int], k: int) -> list[tuple[int, int, int]]:
    """(start in ta, start in tb, length) of the maximal equal run of each anchor of a chain, one entry an anchor."""
    out: list[tuple[int, int, int]] = []
    for p, q in zip(x, y):
        if out and out[-1][1] - out[-1][0] == q - p and p + k <= out[-1][0] + out[-1][2]:
            out.append(out[-1])
            continue
        left = _common(ta[:p][::-1], tb[:q][::-1])
        out.append((p - left, q - left, left + k + _common(ta[p + k :], tb[q + k :])))
    return out


_FOUND = "doc long, low int, high int, shared boolean"


def _align_batches(span: int, k: int):
    """Shared spans [low, high) of both texts, and starts low to high of windows that the star leaves open."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = set()
            for a, b, a_at, b_at, star, ta, tb in zip(*(df[c] for c in ("a", "b", "a_at", "b_at", "star", "ta", "tb"))):
                low_a, low_b = max(int(a_at[0]) - span, 0), max(int(b_at[0]) - span, 0)
                held = runs(ta, tb, (a_at - low_a).tolist(), (b_at - low_b).tolist(), k)
                for p, q, n in set(held):
                    if n >= span:
                        rows.add((a, p + low_a, p + low_a + n, True))
                        rows.add((b, q + low_b, q + low_b + n, True))
                for at, s, (_, q, n) in zip(b_at.tolist(), star, held):
                    if not s:
                        continue
                    first, start, end = max(at + k - span, 0), q + low_b, q + low_b + n
                    if n < span:
                        rows.add((b, first, at, False))
                        continue
                    if start > first:
                        rows.add((b, first, min(start - 1, at), False))
                    if end - span < at:
                        rows.add((b, max(end - span + 1, first), at, False))
            yield pd.DataFrame(list(rows), columns=["doc", "low", "high", "shared"])

    return run


def _window_batches(span: int):
    """(doc, at, h1, h2): the windows of each text that begin in one of its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            total = 0
            for doc, text, near in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                codes, last_end = points(text.as_py()), -1
                low, high = (np.asarray(near.values.field(name), dtype=np.int64) for name in ("low", "high"))
                for n in np.argsort(low, kind="stable"):
                    a, b = max(int(low[n]), last_end + 1), min(int(high[n]), len(codes) - span)
                    if a > b:
                        continue
                    last_end = b
                    here = codes[a : b + span]
                    for column, values in zip(parts, (np.full(b - a + 1, doc, dtype=np.int64), np.arange(a, b + 1), window_hashes(here, span, _BASES[0]), window_hashes(here, span, _BASES[1]))):
                        column.append(values)
                    total += b - a + 1
                if total >= PIECE:
                    yield _window_batch(parts)
                    parts, total = [[], [], [], []], 0
            if total:
                yield _window_batch(parts)

    return run


def _window_batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    doc, at, h1, h2 = (np.concatenate(c) for c in parts)
    return pa.RecordBatch.from_arrays([_long(doc), pa.array(at.astype(np.int32)), _long(h1), _long(h2)], names=["doc", "at", "h1", "h2"])


def equal_windows(texts: DataFrame, near: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc, at, hub, hub_at): windows that begin in the ranges ``near`` (doc, low, high) and stand in two texts, with the first of their equals."""
    # per start the furthest end, so a text's list is never longer than the text
    lists = near.groupBy("doc", "low").agg(F.max("high").alias("high")).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("near"))
    windows = cut(texts.join(lists, F.col("rep") == F.col("doc")).select("doc", "text", "near").mapInArrow(_window_batches(span), "doc long, at int, h1 long, h2 long"))
    common = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("hub"), F.max("doc").alias("far")).filter("hub.doc <> far")
    return windows.join(common, ["h1", "h2"]).select("doc", "at", F.col("hub.doc").alias("hub"), F.col("hub.at").alias("hub_at"))


def _full(unsettled: DataFrame, span: int, k: int) -> DataFrame:
    """Ranges of all windows round occurrences."""
    return unsettled.select("doc", F.greatest(F.col("pos") + (k - span), F.lit(0)).alias("low"), F.col("pos").alias("high"))


def shared_ranges(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, pairwise: int = PAIRWISE) -> tuple[DataFrame, DataFrame]:
    """(members: doc, rep, copies, length), (ranges: rep, low, high): the union of the shared spans of each distinct text."""
    members, texts = text_classes(documents, key, text, span)
    members, texts = cut(members), cut(texts)
    anchors, unsettled = shared_anchors(cut(seeds_of(texts, span, k)), pairwise)
    aligned = cut(_with_texts(chains(anchors, k), texts, span, k).select("a", "b", "a_at", "b_at", "star", "ta", "tb").mapInPandas(_align_batches(span, k), _FOUND))
    near = aligned.filter("NOT shared").select("doc", "low", "high").unionByName(_full(unsettled, span, k))
    windows = equal_windows(texts, near, span)
    spans = aligned.filter("shared").select("doc", "low", "high").unionByName(windows.select("doc", F.col("at").alias("low"), (F.col("at") + span).alias("high")))
    # per start the furthest end: a hub that thousands share has few of them
    spans = spans.groupBy("doc", "low").agg(F.max("high").alias("high"))
    so_far = Window.partitionBy("doc").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    begun = spans.withColumn("begins", F.coalesce(F.col("low") > F.max("high").over(so_far), F.lit(True)).cast("int"))
    begun = begun.withColumn("n", F.sum("begins").over(Window.partitionBy("doc").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return members, begun.groupBy(F.col("doc").alias("rep"), "n").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("rep", "low", "high")


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(key, start, end): the characters of each document that lie inside shared spans, as ranges that do not touch.

    See ``shared_lengths`` for the defined cases.
    """
    members, ranges = shared_ranges(documents, key, text, **params)
    whole = members.filter("copies > 1").select("doc", F.lit(0).alias("low"), F.col("length").alias("high"))
    parts = members.filter("copies = 1").join(ranges, "rep").select("doc", "low", "high")
    return whole.unionByName(parts).select(F.col("doc").alias(key), F.col("low").alias("start"), F.col("high").alias("end"))


def shared_lengths(documents: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(key, shared_chars): per document the characters inside spans that another document has too.

    A span has ``span`` or more code points, equal code point for code point. Defined cases: null, empty
    and shorter texts and null keys have no row, nor has a text that shares nothing; a copy of
    another document is shared whole; a passage repeated inside one document alone is not shared;
    rows repeated with one key are one document; other columns are not read; an empty table gives an
    empty result. The window hashes have 128 bits, seeds 64, and seeds are compared on the texts.
    """
    spans = shared_spans(documents, key, text, **params)
    return spans.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("shared_chars"))


def _identity(a: str, b: str, a_at: list[int], b_at: list[int], k: int) -> tuple[int, int]:
    """(aligned characters, equal ones): seeds match as they are, gaps between them are aligned."""
    equal, total, x, y = 0, 0, a_at[0], b_at[0]
    for p, q in zip(a_at, b_at):
        if p > x and q > y:
            gap_a, gap_b = a[x:p], b[y:q]
            equal += len(gap_a) if gap_a == gap_b else sum(m.size for m in SequenceMatcher(None, gap_a, gap_b, autojunk=False).get_matching_blocks())
            total += max(len(gap_a), len(gap_b))
        new = k - max(x - p, y - q, 0)
        equal, total = equal + max(new, 0), total + max(new, 0)
        x, y = p + k, q + k
    return total, equal


_PASSAGES = "doc_a long, doc_b long, a_start int, a_end int, b_start int, b_end int, anchors int, identity double, open array<struct<low:int,high:int>>"


def _passage_batches(span: int, k: int, least_anchors: int):
    """Aligned chains, and with each the starts of windows that a star leaves open."""
    names = ["doc_a", "doc_b", "a_start", "a_end", "b_start", "b_end", "anchors", "identity", "open"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for a, b, a_at, b_at, star, ta, tb in zip(*(df[c] for c in ("a", "b", "a_at", "b_at", "star", "ta", "tb"))):
                low_a, low_b = max(int(a_at[0]) - span, 0), max(int(b_at[0]) - span, 0)
                x, y = (a_at - low_a).tolist(), (b_at - low_b).tolist()
                held = runs(ta, tb, x, y, k)
                left, right = x[0] - held[0][0], held[-1][0] + held[-1][2] - x[-1] - k
                total, equal = _identity(ta, tb, x, y, k)
                kept = len(x) >= least_anchors or x[-1] + k + right - x[0] + left >= span
                ranges = []
                for at, s, (_, q, n) in zip(b_at.tolist(), star, held):
                    first, start, end = max(at + k - span, 0), q + low_b, q + low_b + n
                    if s and n < span:
                        ranges.append((first, at))
                    elif s and start > first:
                        ranges.append((first, min(start - 1, at)))
                    if s and n >= span and end - span < at:
                        ranges.append((max(end - span + 1, first), at))
                share = (equal + left + right) / (total + left + right)
                rows.append((a, b, int(a_at[0]) - left, int(a_at[-1]) + k + right, int(b_at[0]) - left, int(b_at[-1]) + k + right, len(x) if kept else 0, round(share, 4), [{"low": p, "high": q} for p, q in ranges]))
            yield pd.DataFrame(rows, columns=names)

    return run


def fuzzy_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = FUZZY_K, least_anchors: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_a, doc_b, a_start, a_end, b_start, b_end, anchors, identity): passages of representatives and their members.

    Distinct texts that share a seed are compared: directly if few texts have it, else each with the
    seed's hub ``doc_a``. A chain is extended to both sides as far as the texts agree. Chains of
    fewer than ``least_anchors`` seeds stay if they so reach ``span`` characters. Runs that texts share
    with each other but not with the hub have a hub of their own; they come with anchors 0 and
    identity 1 (``doc_a`` = ``doc_b`` where a hub has such a run twice).

    No link is lost: two texts share a run of ``span`` characters only if they have a row together or
    each has a row with one representative ``doc_a`` and the two ranges in it overlap by ``span``. So
    a passage of n texts has n rows, not n squared. Of equal texts the least key stands for all;
    see ``shared_lengths`` for the other defined cases.
    """
    _, texts = text_classes(documents, key, text, span)
    texts = cut(texts)
    anchors, unsettled = shared_anchors(cut(seeds_of(texts, span, k)), pairwise)
    aligned = cut(_with_texts(chains(anchors, k), texts, span, k).select("a", "b", "a_at", "b_at", "star", "ta", "tb").mapInPandas(_passage_batches(span, k, least_anchors), _PASSAGES))
    near = aligned.select(F.col("doc_b").alias("doc"), F.explode("open").alias("r")).select("doc", "r.low", "r.high").unionByName(_full(unsettled, span, k))
    windows = equal_windows(texts, near, span).filter("doc <> hub OR at <> hub_at").withColumn("shift", F.col("at") - F.col("hub_at"))
    in_order = Window.partitionBy("hub", "doc", "shift").orderBy("at")
    windows = windows.withColumn("island", F.col("at") - F.row_number().over(in_order))
    ranges = windows.groupBy("hub", "doc", "shift", "island").agg(F.min("at").alias("b_start"), (F.max("at") + span).alias("b_end"))
    rest = ranges.select(
        F.col("hub").alias("doc_a"), F.col("doc").alias("doc_b"), (F.col("b_start") - F.col("shift")).alias("a_start"), (F.col("b_end") - F.col("shift")).alias("a_end"), "b_start", "b_end",
        F.lit(0).alias("anchors"), F.lit(1.0).alias("identity"),
    )
    return aligned.filter("anchors > 0").drop("open").unionByName(rest)
