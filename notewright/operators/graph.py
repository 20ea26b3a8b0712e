"""Links between titles, and graphs made of them."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from notewright.functions.text import tokens
from notewright.session import cut, spread

#: Least spelling ratio and least Jaccard of a resolved link; decay, least flow and size of spreading activation.
FUZZY, JACCARD = 0.82, 0.34
DECAY, LEAST_FLOW, SETTLED = 0.65, 0.05, 20
#: Up to so many rare terms, counted before, are sent to the tasks that hold the sets.
SENT = 1 << 18


#: Texts in a block of links and in one of titles.
LINKS, TITLES = 1024, 4096
#: Classes of characters and of pairs of them; texts in one class only raise a bound.
_CHARS, _PAIRS = 64, 256


def _counts(codes: list[np.ndarray], classes: int, step: int) -> np.ndarray:
    """How often each text has each class of runs of ``step`` characters."""
    out = np.zeros((len(codes), classes), dtype=np.int32)
    for row, c in zip(out, codes):
        runs = c if step == 1 else c[:-1] * 31 + c[1:]
        row += np.bincount(runs % classes, minlength=classes).astype(np.int32)
    return out


def _alike_spelling(least: float):
    """Pairs of blocks to (link, title, ratio) of ``least`` or more.

    The ratio is 2 M / L for M matched characters of L in both texts. M is at most the characters
    that both have, so it bounds the ratio; and the matched runs are at most one more than the
    L - 2 M unmatched characters, so the texts share at least M - (L - 2 M) - 1 pairs of characters.
    Both bounds hold for the ratio of the standard library, which decides about what they let pass.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for links, titles in zip(df["links"], df["titles"]):
                sides = []
                for block in (links, titles):
                    low = [x["low"] for x in block]
                    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for t in low]
                    sides.append(([x["key"] for x in block], low, np.array([len(c) for c in codes]), _counts(codes, _CHARS, 1), _counts(codes, _PAIRS, 2)))
                (names, low, sizes, chars, pairs), (t_names, t_low, t_sizes, t_chars, t_pairs) = sides
                for i, name in enumerate(names):
                    total = sizes[i] + t_sizes
                    matched = np.ceil((least - 1e-6) * total / 2)
                    near = np.flatnonzero(np.minimum(sizes[i], t_sizes) >= matched)
                    near = near[np.minimum(t_chars[near], chars[i]).sum(axis=1) >= matched[near]]
                    near = near[np.minimum(t_pairs[near], pairs[i]).sum(axis=1) >= 3 * matched[near] - total[near] - 1]
                    for j in near:
                        ratio = round(SequenceMatcher(None, low[i], t_low[j]).ratio(), 6)
                        if ratio >= least:
                            rows.append((name, t_names[j], ratio))
            yield pd.DataFrame(rows, columns=["link", "title", "ratio"])

    return run


def _blocks(texts: DataFrame, column: str, name: str, size: int) -> DataFrame:
    """(name): the distinct texts and their lower case in blocks of about ``size``."""
    rows = cut(texts.select(F.col(column).alias("key")).filter("key IS NOT NULL").distinct())
    n = max(-(-rows.count() // size), 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)))
    return rows.groupBy("block").agg(F.collect_list(F.struct("key", F.lower("key").alias("low"))).alias(name)).select(name)


def exact_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(link, title): links that are a title but for letter case; of titles alike the last wins."""
    last = titles.groupBy(F.lower("title").alias("low")).agg(F.max("title").alias("title"))
    return links.select("link").distinct().join(last, F.lower("link") == F.col("low")).select("link", "title")


def _alike(links: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """(link, title, jaccard) with a Jaccard of terms of ``least`` or more, by a prefix filter.

    Terms are ordered by how many titles have them; a pair that reaches the threshold shares one of the
    first ``size - ceil(least * size) + 1`` terms of both, so frequent terms are seldom joined.
    """
    sides = []
    frequency = titles.select(F.explode(F.array_distinct(tokens(F.col("title")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for df, name in ((links, "link"), (titles, "title")):
        sets = df.select(F.col(name).alias("key")).distinct().withColumn("set", F.array_distinct(tokens(F.col("key")))).filter(F.size("set") > 0)
        terms = sets.select("key", F.explode("set").alias("term")).join(frequency, "term", "left")
        ranked = terms.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("r"))
        ranked = ranked.select("key", F.transform("r", lambda x: x["term"]).alias("set"))
        n = F.size("set") - F.ceil(F.size("set") * F.lit(least) - 1e-9).cast("int") + 1
        sides.append(ranked.select("key", "set", F.explode(F.slice("set", F.lit(1), n)).alias("term")))
    left, right = sides[0].toDF("link", "ls", "term"), sides[1].toDF("title", "ts", "term")
    pairs = left.join(right, "term").select("link", "title", "ls", "ts").distinct()
    shared = F.size(F.array_intersect("ls", "ts"))
    return pairs.withColumn("jaccard", F.round(shared / F.size(F.array_union("ls", "ts")), 6)).filter(F.col("jaccard") >= least).select("link", "title", "jaccard")


def _best(df: DataFrame, score: str, larger: bool) -> DataFrame:
    """The best title of each link; ties go to the larger or the smaller title."""
    best = df.groupBy("link").agg(F.max(score).alias(score))
    return df.join(best, ["link", score]).groupBy("link", score).agg((F.max if larger else F.min)("title").alias("title")).select("link", "title", score)


def jaccard_links(links: DataFrame, titles: DataFrame, least: float = JACCARD) -> DataFrame:
    """(link, title, jaccard): the title whose terms are most like the link's."""
    return _best(_alike(links, titles, least), "jaccard", larger=False)


def fuzzy_links(links: DataFrame, titles: DataFrame, least: float = FUZZY) -> DataFrame:
    """(link, title, ratio): the title whose spelling is most like the link's; of equal ratios the larger title.

    Every link is compared with every title, block by block; the spelling ratio itself is taken only
    of pairs that bounds of it let pass.
    """
    blocks = spread(_blocks(links, "link", "links", LINKS).crossJoin(_blocks(titles, "title", "titles", TITLES)))
    return _best(cut(blocks.mapInPandas(_alike_spelling(least), "link string, title string, ratio double")), "ratio", larger=True)


def resolve_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(link, title, method): each distinct link by the first way that resolves it: exact, fuzzy, jaccard."""
    distinct = links.select("link").filter("link IS NOT NULL").distinct()
    exact = cut(exact_links(distinct, titles))
    open_ = cut(distinct.join(exact, "link", "left_anti"))
    fuzzy = cut(fuzzy_links(open_, titles).select("link", "title"))
    rest = jaccard_links(open_.join(fuzzy, "link", "left_anti"), titles).select("link", "title")
    return exact.withColumn("method", F.lit("exact")).unionByName(fuzzy.withColumn("method", F.lit("fuzzy"))).unionByName(rest.withColumn("method", F.lit("jaccard")))


def open_adjacency(notes: DataFrame) -> DataFrame:
    """(src, dst), both directions: notes and their links as they are written; a link that no note has as its title is a node too."""
    links = notes.select(F.col("title").alias("src"), F.explode("links").alias("dst"))
    return adjacency(links.filter("src IS NOT NULL AND dst IS NOT NULL"))


def adjacency(resolved: DataFrame) -> DataFrame:
    """(src, dst), both directions, distinct, without self links; ``resolved`` has src, dst."""
    one = resolved.select("src", "dst").filter("src <> dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node, hops): nodes within ``depth`` hops of each seed, the seed itself left out."""
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")).distinct()
    front = seen
    for hop in range(1, max(depth, 1) + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def weighted_graph(authored: DataFrame, inferred: DataFrame, cap: float = 0.85) -> DataFrame:
    """(src, dst, weight, kind), both directions: authored links weigh 1, inferred ones their similarity up to ``cap``; authored wins."""
    a = authored.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(1.0).alias("weight"), F.lit("authored").alias("kind"))
    b = inferred.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.least(F.col("similarity"), F.lit(cap)).alias("weight"), F.lit("inferred").alias("kind"))
    best = a.unionByName(b).filter("lo <> hi").groupBy("lo", "hi").agg(F.max(F.struct((F.col("kind") == "authored").alias("first"), "weight", "kind")).alias("e"))
    one = best.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "e.weight", "e.kind")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "kind"))


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, edges, avg_degree, isolated) of an undirected graph kept in both directions."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    all_ = nodes.select("node").distinct().join(degree, F.col("node") == F.col("src"), "left")
    d = F.coalesce("degree", F.lit(0))
    return all_.agg(
        F.count("*").alias("nodes"), F.floor(F.coalesce(F.sum(d), F.lit(0)) / 2).cast("long").alias("edges"),
        F.round(F.avg(d), 2).alias("avg_degree"), F.count_if(d == 0).alias("isolated"),
    )


def hubs(edges: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes of most links; ties by name."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def degree_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


def edges_by_kind(edges: DataFrame) -> DataFrame:
    """(kind, edges) of a weighted graph kept in both directions."""
    return edges.filter("src < dst").groupBy("kind").agg(F.count("*").alias("edges"))


def activation(edges: DataFrame, seeds: DataFrame, decay: float = DECAY, least: float = LEAST_FLOW, settled: int = SETTLED) -> DataFrame:
    """(seed, node, activation, parent, via): spreading activation from each seed, the best ``settled`` nodes.

    ``parent`` is the settled node that the largest flow came from, ``via`` the kind of that edge.

    A node's activation is the largest product of decayed weights on any way from the seed; flows
    under ``least`` stop. Each factor is below 1, so the number of rounds is bounded by the decay and
    the best nodes are the ones a best-first search would settle. Rounds keep one row per seed and
    node (a maximum), and the frontier holds only rows that grew.
    """
    best = seeds.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("activation")).distinct()
    front = best
    flow = F.round(F.col("activation") * decay * F.col("weight"), 9)
    rounds = 1
    while decay**rounds >= least:
        rounds += 1
    for _ in range(rounds):
        step = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node"), flow.alias("activation")).filter(F.col("activation") >= least)
        step = step.groupBy("seed", "node").agg(F.max("activation").alias("activation"))
        known = best.select("seed", "node", F.col("activation").alias("old"))
        front = cut(step.join(known, ["seed", "node"], "left").filter("old IS NULL OR activation > old").drop("old"))
        best = cut(best.unionByName(front).groupBy("seed", "node").agg(F.max("activation").alias("activation")))
    w = Window.partitionBy("seed").orderBy(F.desc("activation"), "node")
    kept = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= settled)
    from_ = kept.select("seed", F.col("node").alias("parent"), "activation").join(edges, F.col("parent") == F.col("src"))
    came = from_.select("seed", F.col("dst").alias("node"), "parent", "kind", flow.alias("flow"))
    parent = came.groupBy("seed", "node").agg(F.max(F.struct("flow", "parent", "kind")).alias("p"))
    out = kept.join(parent, ["seed", "node"], "left")
    other = F.col("node") != F.col("seed")
    return out.select("seed", "node", "activation", F.when(other, F.col("p.parent")).alias("parent"), F.when(other, F.col("p.kind")).alias("via"))


def rare_token_links(docs: DataFrame, key: str, bag: str, share: float = 0.02, least_df: int = 5, most: int = 400, shared: int = 2, jaccard: float = 0.12, top: int = 6) -> DataFrame:
    """(src, dst, jaccard): links of documents that share ``shared`` or more rare terms, the ``top`` best of each.

    A term is rare if at most max(least_df, share of all documents) and at most ``most`` documents have
    it; these limits are part of the operator's definition and bound each term's pairs. Terms are
    compared by 64-bit hashes; sets are fetched only for pairs that share enough rare ones.

    Spark expects a list to hold one entry, so it takes the sets and their terms for small tables and would send
    them whole by way of the driver; the joins are named here, and only counted rows are sent.
    """
    sets = cut(docs.select(F.col(key).alias("doc"), F.array_distinct(F.transform(bag, lambda t: F.xxhash64(t))).alias("set")))
    total = sets.agg(F.greatest(F.lit(least_df), F.floor(F.count("*") * share).cast("int")).alias("limit"))
    terms = sets.select("doc", F.explode("set").alias("term"))
    frequency = terms.groupBy("term").agg(F.count("*").alias("df")).filter(f"df BETWEEN 2 AND {most}")
    rare = cut(frequency.crossJoin(F.broadcast(total)).filter("df <= limit").select("term"))  # one row of totals
    held = terms.join(F.broadcast(rare) if rare.count() <= SENT else rare.hint("merge"), "term")
    pairs = held.select("term", F.col("doc").alias("a")).join(held.select("term", F.col("doc").alias("b")).hint("merge"), "term").filter("a < b")
    pairs = cut(pairs.groupBy("a", "b").agg(F.count("*").alias("hits")).filter(F.col("hits") >= shared).select("a", "b"))
    side = lambda n: sets.select(F.col("doc").alias(n), F.col("set").alias(f"s{n}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("a", "b", F.round(inter / (F.size("sa") + F.size("sb") - inter), 6).alias("jaccard")).filter(F.col("jaccard") >= jaccard)
    ends = scored.select(F.col("a").alias("src"), F.col("b").alias("dst"), "jaccard").unionByName(scored.select(F.col("b").alias("src"), F.col("a").alias("dst"), "jaccard"))
    w = Window.partitionBy("src").orderBy(F.desc("jaccard"), "dst")
    return ends.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top).drop("n")
