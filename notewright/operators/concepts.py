"""Concepts and their evidence, merging of notes, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from notewright.session import cut

#: Similarities from which an item is merged or linked.
MERGE, LINK = 0.88, 0.72


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _as_field(name: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"))


def last_by_title(notes: DataFrame, *columns: str) -> DataFrame:
    """Of notes with one title the last by file name; only ``columns`` are read, all if none is named."""
    wanted = [c for c in (columns or notes.columns) if c != "title"] or ["file_name"]
    picked = notes.filter("title IS NOT NULL").groupBy("title").agg(F.max_by(F.struct(*wanted), "file_name").alias("n"))
    return picked.select("title", "n.*")


def merge_titles(notes: DataFrame) -> DataFrame:
    """(title, content, tags, applies_norm, sources, observed_on, members): one note per exact title.

    The longest content (the first file on a tie), the union of tags and of norms, all sources in file
    order, the base's own day or else the first one in file order; links are reset by leaving them out.
    """
    rows = notes.filter("title IS NOT NULL")
    longest = F.struct(F.coalesce(F.length("content"), F.lit(0)).alias("n"))
    rows = rows.withColumn("size", longest["n"])
    day = F.nullif(F.col("observed_on"), F.lit(""))
    base = rows.groupBy("title").agg(F.max("size").alias("size"))
    first = rows.join(base, ["title", "size"]).groupBy("title").agg(F.min_by("content", "file_name").alias("content"), F.min_by(F.struct(day.alias("d")), "file_name")["d"].alias("own_day"))
    # values are made distinct before they are gathered
    named = F.concat(*[F.transform(_empty(c), _as_field(c)) for c in ("tags", "applies_norm")])
    values = rows.select("title", F.explode(named).alias("x")).select("title", "x.*").distinct()
    lists = values.groupBy("title").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == c, F.col("value")))).alias(c) for c in ("tags", "applies_norm")])
    none = F.array().cast("array<string>")
    rest = rows.groupBy("title").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("file_name", "source_transcript"))), lambda x: x["source_transcript"]).alias("sources"),
        F.min_by(day, F.when(day.isNotNull(), F.col("file_name"))).alias("first_day"),
        F.count("*").alias("members"),
    )
    return first.join(rest, "title").join(lists, "title", "left").select("title", "content", F.coalesce("tags", none).alias("tags"), F.coalesce("applies_norm", none).alias("applies_norm"), "sources", F.coalesce("own_day", "first_day").alias("observed_on"), "members")


def clean_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence once per (concept_id, ord): rows delivered twice count once."""
    return evidence.dropDuplicates(["concept_id", "ord", "source", "observed_on", "detail", "contradicts"])


def strength(evidence: DataFrame) -> DataFrame:
    """(concept_id, strength, contradicting, first_seen, last_seen): distinct sources for and against, first and last date string."""
    against = F.coalesce("contradicts", F.lit(False))
    source, seen = F.nullif(F.trim("source"), F.lit("")), F.nullif(F.col("observed_on"), F.lit(""))
    return evidence.groupBy("concept_id").agg(
        F.count_distinct(F.when(~against, source)).alias("strength"),
        F.count_distinct(F.when(against, source)).alias("contradicting"),
        F.min(seen).alias("first_seen"),
        F.max(seen).alias("last_seen"),
    )


def compounding(strengths: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: concepts, sum of strength, ratio, those seen more than once, at most once, and contested ones."""
    s = F.coalesce("strength", F.lit(0))
    rows = concepts.select(F.col("id")).join(strengths, F.col("id") == F.col("concept_id"), "left")
    return rows.agg(
        F.count("*").alias("concepts"), F.sum(s).alias("observations"), F.round(F.sum(s) / F.count("*"), 2).alias("ratio"),
        F.count_if(s > 1).alias("reinforced"), F.count_if(s <= 1).alias("single"), F.count_if(F.coalesce("contradicting", F.lit(0)) > 0).alias("contested"),
    )


def absorb(base: DataFrame, other: DataFrame, on: str = "id") -> DataFrame:
    """Base concepts after taking in ``other`` (same key): aliases and the other's title, unions of lists, the longer content."""
    o = other.select(on, *[F.col(c).alias(f"o_{c}") for c in ("title", "content", "tags", "aliases", "links", "applies_norm")])
    both = base.join(o, on)
    union = lambda c: F.array_union(_empty(c), _empty(f"o_{c}"))
    added = F.array_union(F.array_union(_empty("aliases"), F.array_compact(F.array("o_title"))), _empty("o_aliases"))
    longer = F.when(F.coalesce(F.length("o_content"), F.lit(0)) > F.coalesce(F.length("content"), F.lit(0)), F.col("o_content")).otherwise(F.col("content"))
    return both.select(
        on, "title", longer.alias("content"), union("tags").alias("tags"), F.array_except(added, F.array("title")).alias("aliases"),
        F.array_union(_empty("links"), F.array_except(_empty("o_links"), F.array("title"))).alias("links"), union("applies_norm").alias("applies_norm"),
    )


def absorb_evidence(evidence: DataFrame, absorbed: DataFrame) -> DataFrame:
    """``evidence`` after concepts were taken in by others; ``absorbed`` has id and into.

    Their rows move to the concept that took them in and are numbered after its own, but for those whose
    source and detail it has already; so taking in the same rows again adds nothing.
    """
    gone = absorbed.select(F.col("id").alias("concept_id"), "into").distinct()
    kept = evidence.join(gone.select("concept_id"), "concept_id", "left_anti")
    mark = F.xxhash64(F.coalesce("source", F.lit("\u0000")), F.lit("\u0001"), F.coalesce("detail", F.lit("\u0000")))
    moved = evidence.join(gone, "concept_id").withColumn("_from", F.col("concept_id")).withColumn("concept_id", F.col("into")).drop("into").withColumn("_mark", mark)
    moved = moved.join(kept.select("concept_id", mark.alias("_mark")).distinct(), ["concept_id", "_mark"], "left_anti").drop("_mark")
    last = kept.groupBy("concept_id").agg(F.max("ord").alias("_last"))
    place = F.row_number().over(Window.partitionBy("concept_id").orderBy("_from", "ord"))
    moved = moved.join(last, "concept_id", "left").withColumn("ord", (F.coalesce("_last", F.lit(0)) + place).cast(evidence.schema["ord"].dataType))
    return kept.unionByName(moved.select(*kept.columns))


def tied_notes(ties: DataFrame, notes: DataFrame, on: str = "id", by: str = "t") -> DataFrame:
    """(on, title, content, tags, aliases, links, applies_norm): all notes that ``ties`` (on, by) bring to a concept, in one row for ``absorb``.

    Absorbing that row equals absorbing the notes one by one by note_id: titles become aliases, lists
    keep the order in which their values first come, of the longest contents the first stays. Values
    are made distinct before they are gathered, so a concept with many notes is spread over its values.
    """
    pairs = ties.select(on, by).distinct()
    lists = {"aliases": F.array("title")} | {c: _empty(c) for c in ("tags", "links", "applies_norm")}
    named = lambda name: lambda x, i: F.struct(F.lit(name).alias("field"), x.alias("value"), i.alias("i"))
    items = F.concat(*[F.transform(v, named(name)) for name, v in lists.items()])
    values = notes.select(by, "note_id", F.explode(items).alias("x")).select(by, "x.field", "x.value", F.struct("note_id", "x.i").alias("place")).filter("value IS NOT NULL")
    values = values.groupBy(by, "field", "value").agg(F.min("place").alias("place"))
    values = pairs.join(values, by).groupBy(on, "field", "value").agg(F.min("place").alias("place"))
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("place", "value")))), lambda x: x["value"])
    lists = values.groupBy(on).agg(*[listed(c).alias(c) for c in lists])
    size = F.coalesce(F.length("content"), F.lit(0))
    longest = notes.groupBy(by).agg(F.max(F.struct(size.alias("n"), (-F.col("note_id")).alias("m"))).alias("best"))
    longest = pairs.join(longest, by).groupBy(on).agg(F.max("best").alias("best")).select(on, (-F.col("best.m")).alias("note_id"), "best.n")
    content = longest.join(notes.select("note_id", "content", size.alias("n")), ["note_id", "n"]).groupBy(on).agg(F.max("content").alias("content"))
    return content.join(lists, on, "left").select(on, F.lit(None).cast("string").alias("title"), "content", "tags", "aliases", "links", "applies_norm")


def decide(best: DataFrame, mode: str = "harness", merge: float = MERGE, link: float = LINK) -> DataFrame:
    """(query, action, target, score): what happens to each incoming item given its nearest stored one.

    ``best`` has query, doc and score of rank 1, with nulls where nothing is stored.
    """
    middle = "ambiguous" if mode == "harness" else "link"
    action = F.when(F.col("score") >= merge, "merge").when(F.col("score") >= link, middle).otherwise("create")
    return best.select("query", action.alias("action"), F.when(F.col("score") >= link, F.col("doc")).alias("target"), "score")


def settle(decisions: DataFrame, judge: Callable[[str, str], bool | None]) -> DataFrame:
    """``decisions`` with the ambiguous ones settled by an injected judge of (query, target).

    Same: merge. Different, no answer, or a failing call: link.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def verdict(action: str, query: str, target: str) -> str:
            if action != "ambiguous":
                return action
            try:
                return "merge" if judge(query, target) else "link"
            except Exception:  # noqa: BLE001
                return "link"

        for df in frames:
            df["action"] = [verdict(a, q, t) for a, q, t in zip(df["action"], df["query"], df["target"])]
            yield df

    return decisions.mapInPandas(run, decisions.schema)


def greedy_absorption(pairs: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """(id, absorbed): greedy consolidation in the given order, by rounds.

    ``pairs`` are (a, b, score) of similar concepts, ``order`` (id, place), unique. A concept takes in
    its partners that nobody took before. In each round every open concept that precedes all its open
    partners acts and closes them, so a round is a few joins and aggregations, and the result equals
    the one-by-one order.
    """
    both = pairs.filter(F.col("score") >= threshold)
    both = both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    places = order.select("id", "place")
    # merge joins: there is a place for each concept, and Spark takes them for fewer bytes than they are
    at = lambda n: places.select(F.col("id").alias(n), F.col("place").alias(f"p{n}")).hint("merge")
    both = both.join(at("a"), "a").join(at("b"), "b")
    both = cut(both)
    links, closed = both, both.select("a").limit(0)
    while not links.isEmpty():
        acts = cut(links.groupBy("a", "pa").agg(F.min("pb").alias("least")).filter("pa < least").select("a"))
        met = cut(links.join(acts, "a").select(F.col("b").alias("a")).distinct())
        closed = closed.unionByName(met)
        gone = acts.unionByName(met)
        left = links.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti")
        links = cut(left.select("a", "b", "pa", "pb"))
    # who was never closed acts, if only later; of the acting partners of a concept the first takes it
    return both.join(closed.distinct(), "a", "left_anti").groupBy("b").agg(F.min_by("a", "pa").alias("id")).select("id", F.col("b").alias("absorbed"))


#: Rows of a group that one range of its order holds.
RANGE = 4096


def running(rows: DataFrame, group: list[str], order: str, value: Column, out: str, width: int = RANGE) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the group's rows up to this one in ``order``, a whole number.

    Sums of ranges of the order first, then inside each range, so a group is never one task's work.
    """
    rows = rows.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", value)
    sums = rows.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    same = F.lit(True)
    for g in group:
        same = same & rows[g].eqNullSafe(starts[f"_{g}"])
    inside = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(starts, same & rows["_range"].eqNullSafe(starts["_r"])).withColumn(out, F.sum("_value").over(inside) + F.col("_start")).drop("_range", "_value", "_r", "_start", *[f"_{g}" for g in group])


def _numbered(slug: str, key: str):
    """Slugs of families in order: the first free one of slug, slug-2, slug-3, ..."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, taken, following = None, set(), {}
        for df in frames:
            made = []
            for root, name in zip(df["_root"], df[slug]):
                if root != family:
                    family, taken, following = root, set(), {}
                out = name
                while out in taken:
                    following[name] = following.get(name, 1) + 1
                    out = f"{name}-{following[name]}"
                taken.add(out)
                made.append(out)
            yield pd.DataFrame({key: df[key], "slug": made})

    return run


def unique_slugs(rows: DataFrame, key: str, slug: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """(key, slug): in the given order (whole numbers) each row gets its slug or, if that is taken, the first free one of slug-2, slug-3, ...

    ``taken`` (slug) holds slugs in use. Equal slugs are numbered by ranges of the order; only families
    in which a slug looks like a numbered one (``a`` and ``a-2``) are gone through one after the other.
    """
    root = F.regexp_replace(F.col(slug), r"(-\d+)+$", "")
    held = rows.select(*dict.fromkeys((key, slug, order))).withColumn("_root", root).withColumn("_old", F.lit(1))
    if taken is not None:
        used = taken.select(F.col(slug), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in dict.fromkeys((key, order))]).distinct()
        held = held.unionByName(used.withColumn("_root", root).withColumn("_old", F.lit(0)))
    mixed = held.groupBy("_root").agg(F.bool_or((F.col(slug) != F.col("_root")) | (F.col("_old") == 0)).alias("_mixed"))
    held = cut(held.join(mixed, "_root"))
    plain = running(held.filter(~F.col("_mixed")), [slug], order, F.lit(1), "_n")
    plain = plain.select(key, F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), F.col("_n").cast("string"))).alias("slug"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    families = held.filter("_mixed").repartition(n, "_root").sortWithinPartitions("_root", "_old", F.col(order), slug)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, slug string"
    return plain.unionByName(families.select("_root", slug, key, "_old").mapInPandas(_numbered(slug, key), schema).filter(F.col(key).isNotNull()))


def within_budget(blocks: DataFrame, group: str, order: str, size: str, budget: int, head: int = 0) -> DataFrame:
    """The blocks of each group in order (whole numbers) as long as head and blocks so far fit the budget."""
    return running(blocks, [group], order, F.col(size) + 0, "used").withColumn("used", F.col("used") + head).filter(F.col("used") <= budget)
