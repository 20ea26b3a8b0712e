"""Incremental ingestion of a batch: merge into, link to, or create concepts, with all effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from notewright.functions.text import slug
from notewright.operators.concepts import LINK, MERGE, _empty, unique_slugs
from notewright.session import cut

#: Nearest concepts that are looked at, and of these the most that are linked.
NEAR, LINKED = 5, 3


def decide_in_order(near_store: DataFrame, near_batch: DataFrame, items: DataFrame, mode: str = "harness", merge: float = MERGE, link: float = LINK) -> DataFrame:
    """(item, action, target, in_batch, score): what happens to each item, in order, as if one came after the other.

    ``items`` has item and place (unique, whole numbers); ``near_store`` (item, target, score) the nearest stored
    concepts, ``near_batch`` (item, other, score) the similar items of the batch. An item sees what earlier ones
    created, not what was merged or left open. In each round every item whose earlier similar items are
    settled is settled, so the rounds are as many as the longest chain of similar items in the batch.
    In mode ``harness`` items between the limits are ``ambiguous`` and create nothing; in ``none`` they are linked.
    """
    places = items.select("item", "place")
    before = near_batch.filter(F.col("score") >= link).join(places, "item").join(places.select(F.col("item").alias("other"), F.col("place").alias("at")), "other").filter("at < place")
    before = cut(before.select("item", "other", F.col("score"), "at"))
    stored = cut(near_store.select("item", "target", "score"))
    middle = "ambiguous" if mode == "harness" else "link"
    open_, done = cut(places.select("item")), None
    while not open_.isEmpty():
        blocked = before.join(open_.select(F.col("item").alias("other")), "other", "left_semi").select("item").distinct()
        ready = open_.join(blocked, "item", "left_anti")
        seen = stored.select("item", F.col("target").cast("string").alias("target"), F.lit(False).alias("in_batch"), "score", F.lit(-1).cast("long").alias("at"))
        if done is not None:
            made = done.filter(F.col("action").isin("create", "link")).select(F.col("item").alias("other"))
            seen = seen.unionByName(before.join(made, "other").select("item", F.col("other").cast("string").alias("target"), F.lit(True).alias("in_batch"), "score", F.col("at").cast("long").alias("at")))
        best = seen.join(ready, "item", "left_semi").groupBy("item").agg(F.max(F.struct("score", "at", "target", "in_batch")).alias("b"))
        score = F.col("b.score")
        action = F.when(score >= merge, "merge").when(score >= link, middle).otherwise("create")
        some = F.col("b.score") >= link
        now = ready.join(best, "item", "left").select("item", action.alias("action"), F.when(some, F.col("b.target")).alias("target"), F.when(some, F.col("b.in_batch")).alias("in_batch"), F.coalesce(F.when(some, score), F.lit(0.0)).alias("score"))
        done = cut(now if done is None else done.unionByName(now))
        open_ = cut(open_.join(done.select("item"), "item", "left_anti"))
    return done if done is not None else places.select("item", *[F.lit(None).cast(t).alias(c) for c, t in (("action", "string"), ("target", "string"), ("in_batch", "boolean"), ("score", "double"))])


def ingest(concepts: DataFrame, items: DataFrame, near_store: DataFrame, near_batch: DataFrame, mode: str = "harness", merge: float = MERGE, link: float = LINK) -> dict[str, DataFrame]:
    """The effects of a batch: ``decisions``, ``concepts`` (changed and new ones, whole), ``evidence`` (new rows) and ``pending``.

    ``concepts`` has id, title, content, tags, aliases, links, applies_norm; ``items`` item, place, title, content, source,
    observed_on, detail, tags. A merged item leaves a row of evidence, its title as an alias and its new
    tags with its target; a linked one becomes a concept, tied both ways to at most three near ones;
    one without near ones becomes a concept. Ambiguous items wait in ``pending`` for ``settle_pending``.
    New ids are slugs of titles, numbered where they are taken. Lists keep their order, batch order last.
    """
    decided = cut(decide_in_order(near_store, near_batch, items, mode, merge, link))
    new = items.join(decided.filter(F.col("action").isin("create", "link")).select("item"), "item")
    named = unique_slugs(new.select("place", slug(F.coalesce("title", F.lit(""))).alias("slug")), "place", "slug", "place", concepts.select(F.col("id").alias("slug")))
    new = cut(new.join(named, "place").select("item", F.col("slug").alias("id"), "place", "title", "content", "tags"))
    ids = new.select(F.col("item").cast("string").alias("target"), F.col("id").alias("new_id"))
    decided = decided.join(ids, F.col("in_batch") & (decided["target"] == ids["target"]), "left").select("item", "action", F.coalesce("new_id", decided["target"]).alias("target"), "score")
    decided = cut(decided)
    none = F.array().cast("array<string>")
    every = concepts.select("id", "title", "content", *[_empty(c).alias(c) for c in ("tags", "aliases", "links", "applies_norm")]).unionByName(
        new.select("id", "title", "content", _empty("tags").alias("tags"), none.alias("aliases"), none.alias("links"), none.alias("applies_norm"))
    )
    every = cut(every)
    merged = decided.filter("action = 'merge'").select("item", F.col("target").alias("id")).join(items, "item")
    # near ones of linked items: stored ones and those created before, the best three
    places = items.select("item", "place")
    made = new.select(F.col("item").alias("other"), F.col("id").alias("near"), F.col("place").alias("at"))
    linked = decided.filter("action = 'link'").select("item").join(places, "item")
    near = linked.join(near_store, "item").filter(F.col("score") >= link).select("item", "place", F.col("target").cast("string").alias("near"), "score").unionByName(
        linked.join(near_batch, "item").filter(F.col("score") >= link).join(made, "other").filter("at < place").select("item", "place", "near", "score")
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.desc("near"))
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= LINKED)  # at most NEAR stored ones and the batch's
    titles = every.select(F.col("id").alias("near"), F.col("title").alias("near_title"))
    near = cut(near.join(new.select("item", "id", "title"), "item").join(titles, "near"))
    # additions: (id, field, value) in the order in which they come
    place = lambda n: F.struct("place", n.alias("n")).alias("place")
    adds = merged.select("id", F.lit("aliases").alias("field"), F.col("title").alias("value"), place(F.lit(0)))
    adds = adds.unionByName(merged.select("id", "place", F.posexplode(_empty("tags")).alias("n", "value")).select("id", F.lit("tags").alias("field"), "value", place(F.col("n"))))
    adds = adds.unionByName(near.select("id", F.lit("links").alias("field"), F.col("near_title").alias("value"), place(F.col("n"))))
    adds = adds.unionByName(near.select(F.col("near").alias("id"), F.lit("links").alias("field"), F.col("title").alias("value"), place(F.lit(0))))
    adds = adds.filter("value IS NOT NULL").groupBy("id", "field", "value").agg(F.min("place").alias("place"))
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("place", "value")))), lambda x: x["value"])
    adds = adds.groupBy("id").agg(*[listed(c).alias(f"new_{c}") for c in ("aliases", "tags", "links")])
    changed = every.join(adds, "id", "left").join(new.select("id", F.lit(True).alias("is_new")), "id", "left").filter("is_new OR new_aliases IS NOT NULL")
    more = lambda c: F.array_union(F.col(c), F.coalesce(f"new_{c}", none))
    out = changed.select("id", "title", "content", more("tags").alias("tags"), F.array_except(more("aliases"), F.array("title")).alias("aliases"), more("links").alias("links"), "applies_norm")
    told = F.coalesce(F.nullif("detail", F.lit("")), F.col("title"))
    row = lambda df: df.select("id", "source", "observed_on", told.alias("detail"), "place")
    evidence = row(merged).unionByName(row(items.drop("title", "content", "tags").join(new.select("item", "id", "title"), "item")))
    waiting = decided.filter("action = 'ambiguous'").select("item", "target", "score").join(items, "item")
    return {"decisions": decided, "concepts": out, "evidence": evidence, "pending": waiting}


def settle_pending(concepts: DataFrame, pending: DataFrame, verdicts: DataFrame, link: float = LINK) -> dict[str, DataFrame]:
    """The effects of verdicts (item, target) on pending items: a target merges the item, a null target makes a concept of it, linked as before.

    A target that no concept has counts as null.
    """
    known = verdicts.join(concepts.select(F.col("id").alias("target")), "target").select("item", "target")
    items = pending.withColumnRenamed("target", "nearest")
    settled = items.join(verdicts.select("item").distinct(), "item").join(known, "item", "left")
    # a verdict outweighs any similarity; without one the item's nearest concept stays its neighbour
    near = settled.select("item", F.coalesce("target", "nearest").alias("target"), F.when(F.col("target").isNotNull(), F.lit(2.0)).otherwise(F.least("score", F.lit(1.0))).alias("score"))
    batch = near.select("item", F.col("item").alias("other"), "score").limit(0)
    return ingest(concepts, settled.drop("nearest", "score", "target"), near, batch, "none", 1.5, link)
