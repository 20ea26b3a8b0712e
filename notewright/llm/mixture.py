"""Mixing sources to target weights, by hierarchical budgeting over a domain-language-source tree.

Sizes are tokens of a public tokenizer. A source's target share is spread over its languages as
its tokens are; the weights are summed up the tree and the total is handed down it: each node's
budget goes to its children by weight, no child gets more than all its documents times their
repeats allow, and what a child cannot take goes to its siblings before anything leaves the node.
Each leaf then takes a prefix, in tokens, of its seeded epochs: whole epochs first, then documents
in the seeded order of the last one until the budget is met, the last of them in part.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from notewright.llm.tokens import TOKENIZER, TOKENIZER_DIR, encode_corpus
from notewright.session import cut

SEED = 17
#: An epoch's order is cut into hash ranges of about so many documents; only one range per leaf is sorted.
PER_RANGE = 4096


def clean_source(source: Column) -> Column:
    """Trimmed, lower case, each run of blanks, - or _ one _."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")


def clean_lang(lang: Column) -> Column:
    low = F.lower(F.trim(lang))
    return F.when(low.rlike("^[a-z]{2,3}$"), low).otherwise(F.lit("und"))


def _fill(budget: float, weights: dict, capacity: dict) -> dict:
    """``budget`` by weight, no one over its capacity; the rest goes to those that have room."""
    got = dict.fromkeys(weights, 0.0)
    left, open_ = min(budget, sum(capacity.values())), {c for c in weights if capacity[c] > 0}
    while left > 1e-9 and open_:
        total = sum(weights[c] for c in open_)
        share = {c: left * (weights[c] / total if total > 0 else 1 / len(open_)) for c in open_}
        full = {c for c in open_ if got[c] + share[c] >= capacity[c] - 1e-9}
        if not full:
            for c in open_:
                got[c] += share[c]
            break
        for c in full:
            left -= capacity[c] - got[c]
            got[c] = capacity[c]
        open_ -= full
    return got


def budgets(leaves: list[dict], total: float) -> dict[tuple, int]:
    """Tokens of each leaf (path of domain, language, source); leaves have path, weight, capacity."""
    weight, capacity, children = defaultdict(float), defaultdict(float), defaultdict(set)
    for leaf in leaves:
        path = tuple(leaf["path"])
        for n in range(len(path) + 1):
            weight[path[:n]] += leaf["weight"]
            capacity[path[:n]] += leaf["capacity"]
            if n:
                children[path[: n - 1]].add(path[:n])
    got = {(): min(total, capacity[()])}
    todo = [()]
    while todo:
        node = todo.pop()
        below = sorted(children[node])
        got |= _fill(got[node], {c: weight[c] for c in below}, {c: capacity[c] for c in below})
        todo += [c for c in below if children[c]]
    return {tuple(leaf["path"]): int(round(got[tuple(leaf["path"])])) for leaf in leaves}


def counted(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of documents with at least one token."""
    meta = F.struct("doc_id", clean_source(F.col("source")).alias("source"), clean_lang(F.col("lang")).alias("lang"))
    ids = encode_corpus(documents.select(meta.alias("meta"), "text"), "meta", "text", tokenizer_dir, tokenizer)
    return ids.select("meta.*", F.size("ids").cast("long").alias("n_tokens")).filter("n_tokens > 0")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, domains: dict[str, str] | None = None) -> DataFrame:
    """(domain, lang, source, weight, max_repeats, tokens, budget) of every leaf.

    ``domains`` names the domain of a source, the tree's upper level; a source without one is a domain of its own.

    The driver holds one row per listed source and language; nothing per document. Without
    ``total_tokens`` the mixture has as many tokens as the listed sources hold once.
    """
    wanted = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND source <> ''")
    wanted = wanted.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    domain_of = {k.lower(): v for k, v in (domains or {}).items()}
    rows = wanted.join(sizes.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")), "source", "left").collect()
    held = defaultdict(int)
    for r in rows:
        held[r["source"]] += r["tokens"] or 0
    leaves = []
    for r in rows:
        tokens = r["tokens"] or 0
        part = tokens / held[r["source"]] if held[r["source"]] else 1.0
        leaves.append(
            {"path": (domain_of.get(r["source"], r["source"]), r["lang"] or "none", r["source"]), "weight": r["target_share"] * part,
             "capacity": tokens * max(r["max_repeats"], 0), "tokens": tokens, "repeats": r["max_repeats"]}
        )
    got = budgets(leaves, sum(held.values()) if total_tokens is None else total_tokens)
    made = [(*x["path"], float(x["weight"]), int(x["repeats"]), int(x["tokens"]), min(got[x["path"]], x["capacity"])) for x in leaves]
    schema = "domain string, lang string, source string, weight double, max_repeats int, tokens long, budget long"
    return sizes.sparkSession.createDataFrame(made, schema)


def mix(sizes: DataFrame, leaves: DataFrame, seed: int = SEED, per_range: int = PER_RANGE) -> DataFrame:
    """(doc_id, source, lang, epoch, used_tokens): every use of a document, in part only at a leaf's end.

    The prefix of the last epoch is found in two steps: token sums per hash range, then the order
    inside the one range in which the budget ends. No leaf is sorted or held whole by one task.
    """
    known = leaves.select("lang", "source", F.col("tokens").alias("leaf_tokens"), "budget").filter("budget > 0")
    docs = sizes.join(F.broadcast(known), ["source", "lang"])  # one row per listed source and language
    whole = F.floor(F.col("budget") / F.col("leaf_tokens"))
    docs = docs.withColumn("whole", whole).withColumn("rest", F.col("budget") - whole * F.col("leaf_tokens"))
    full = docs.filter("whole > 0").select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(1), F.col("whole").cast("int"))).alias("epoch"), F.col("n_tokens").alias("used_tokens"))
    order = F.xxhash64(F.lit(seed), (F.col("whole") + 1).cast("long"), F.col("doc_id"))
    leaf = ["source", "lang"]
    counts = sizes.groupBy(*leaf).agg(F.ceil(F.count("*") / per_range).alias("ranges"))
    last = docs.filter("rest > 0").withColumn("o", order).join(F.broadcast(counts.join(F.broadcast(known.select(*leaf)), leaf)), leaf)  # a row a leaf
    last = last.withColumn("range", F.pmod("o", "ranges"))
    sums = last.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("r_tokens"))
    before = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for ``per_range`` documents
    sums = sums.select(*leaf, "range", F.coalesce(F.sum("r_tokens").over(before), F.lit(0)).alias("start"), "r_tokens")
    last = last.join(sums, [*leaf, "range"]).filter("start < rest")
    inner = last.filter(F.col("start") + F.col("r_tokens") <= F.col("rest")).select("doc_id", *leaf, F.col("whole"), F.col("n_tokens").alias("used_tokens"))
    edge = Window.partitionBy(*leaf, "range").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = last.filter(F.col("start") + F.col("r_tokens") > F.col("rest")).withColumn("at", F.col("start") + F.coalesce(F.sum("n_tokens").over(edge), F.lit(0)))
    ends = ends.filter("at < rest").select("doc_id", *leaf, "whole", F.least(F.col("n_tokens"), F.col("rest") - F.col("at")).alias("used_tokens"))
    partial = inner.unionByName(ends).select("doc_id", *leaf, (F.col("whole") + 1).cast("int").alias("epoch"), "used_tokens")
    return full.unionByName(partial)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, tokenizer_dir: str = TOKENIZER_DIR, domains: dict[str, str] | None = None) -> DataFrame:
    """The mixture as uses of documents; see ``mix``.

    Defined cases: sources are matched without regard to letter case, blanks and - or _; null and
    unlisted sources and texts without tokens are not used; a listed source without documents takes
    nothing and its share goes to its siblings; null shares count 0, null repeats 1; repeated
    targets add up; an empty table gives an empty mixture; other columns are not read.
    """
    sizes = cut(counted(documents, tokenizer_dir))
    return mix(sizes, plan(sizes, targets, total_tokens, domains), seed)


def reached_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, tokenizer_dir: str = TOKENIZER_DIR, domains: dict[str, str] | None = None) -> DataFrame:
    """(source, target_share, reached_share, tokens, used_tokens, max_repeats, most_uses) per listed source."""
    sizes = cut(counted(documents, tokenizer_dir))
    leaves = plan(sizes, targets, total_tokens, domains)
    uses = cut(mix(sizes, leaves, seed))
    taken = uses.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.max("epoch").alias("most_uses"))
    listed = leaves.groupBy("source").agg(F.round(F.sum("weight"), 9).alias("target_share"), F.sum("tokens").alias("tokens"), F.max("max_repeats").alias("max_repeats"))
    all_used = taken.agg(F.sum("used_tokens").alias("all_used"))
    out = listed.join(taken, "source", "left").crossJoin(F.broadcast(all_used))  # one row
    used = F.coalesce("used_tokens", F.lit(0))
    return out.select(
        "source", "target_share", F.coalesce(F.round(used / F.col("all_used"), 9), F.lit(0.0)).alias("reached_share"), "tokens",
        used.alias("used_tokens"), "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
