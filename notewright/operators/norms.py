"""The versioned dimension of norms: names, freshness, search, and the audit of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from notewright.functions.text import volatility_days

#: Most names that one pattern holds and a broadcast carries.
MOST_NAMES = 20_000


def expires_on(norms: DataFrame) -> Column:
    return F.date_add(norms["last_verified"], volatility_days(norms["volatility"]))


def with_expiry(norms: DataFrame) -> DataFrame:
    return norms.withColumn("expires_on", F.date_add("last_verified", volatility_days(F.col("volatility"))))


def stale(norms: DataFrame, today: str) -> DataFrame:
    """Norms that were never verified or whose verification has run out before ``today``."""
    dated = with_expiry(norms)
    return dated.filter(F.col("expires_on").isNull() | (F.col("expires_on") < F.lit(today).cast("date"))).select("id", "expires_on")


def norm_names(norms: DataFrame) -> DataFrame:
    """(name, norm_id, is_retired): every name in lower case once; of two norms the later one has it."""
    array = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    retired = F.transform(array(F.transform("supersedes", lambda s: s["name"])), lambda n: F.struct(n.alias("name"), F.lit(True).alias("is_retired"), F.lit(2).alias("n")))
    alias = F.transform(array(F.col("aliases")), lambda n: F.struct(n.alias("name"), F.lit(False).alias("is_retired"), F.lit(1).alias("n")))
    current = F.array(F.struct(F.col("current").alias("name"), F.lit(False).alias("is_retired"), F.lit(0).alias("n")))
    rows = norms.select("id", "ord", F.explode(F.concat(current, alias, retired)).alias("x"))
    rows = rows.select(F.lower(F.trim("x.name")).alias("name"), F.col("id").alias("norm_id"), "x.is_retired", "ord", F.col("x.n").alias("n")).filter("name <> ''")
    last = rows.groupBy("name").agg(F.max(F.struct("ord", "n", "norm_id", "is_retired")).alias("e"))
    return last.select("name", "e.norm_id", "e.is_retired")


def resolve(values: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``values`` with norm_id and is_retired of the name in ``column``, null where no norm has it."""
    return values.join(names, F.lower(F.trim(column)) == F.col("name"), "left").drop("name")


def lookup(asked: DataFrame, column: str, norms: DataFrame) -> DataFrame:
    """(asked, norm_id, found_by): a norm by its id or, failing that, by one of its names."""
    ids = norms.select(F.col("id").alias("by_id"))
    out = asked.select(F.col(column).alias("asked")).distinct().join(ids, F.col("asked") == F.col("by_id"), "left")
    out = resolve(out, "asked", norm_names(norms))
    found_by = F.when(F.col("by_id").isNotNull(), "id").when(F.col("norm_id").isNotNull(), F.when(F.col("is_retired"), "retired name").otherwise("name")).otherwise("missing")
    return out.select("asked", F.coalesce("by_id", "norm_id").alias("norm_id"), found_by.alias("found_by"))


def migrations(norms: DataFrame) -> DataFrame:
    """(name, norm_id, superseded_by, migration, authority): what replaces a retired name; the first entry counts."""
    rows = norms.select("id", "current", "ord", F.col("authority").alias("own"), F.posexplode("supersedes").alias("at", "s"))
    rows = rows.select(F.lower(F.trim("s.name")).alias("name"), "id", "current", "ord", "at", F.col("s.migration").alias("migration"), F.coalesce("s.authority", "own").alias("authority"))
    first = rows.filter("name <> ''").groupBy("name").agg(F.min(F.struct((-F.col("ord")).alias("o"), "at", "id", "current", "migration", "authority")).alias("e"))
    return first.select("name", F.col("e.id").alias("norm_id"), F.col("e.current").alias("superseded_by"), "e.migration", "e.authority")


def _bounded_name(name: Column) -> Column:
    return F.concat(F.lit(r"(?i)(^|[^A-Za-z0-9_])"), F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"), F.lit(r"($|[^A-Za-z0-9_])"))


def _any_of(names: list[str]) -> str:
    """One pattern that finds whether a text has any of the names as a word; names of one beginning share it."""
    quoted = lambda n: "".join("\\" + c if c in r"\.[]{}()*+?^$|-" else c for c in n)
    heads: dict[str, list[str]] = {}
    for n in sorted(names):
        heads.setdefault(n[:2], []).append(n[2:])
    inner = "|".join(f"{quoted(h)}(?:{'|'.join(quoted(t) for t in tails)})" for h, tails in heads.items())
    return rf"(?i)(?<![A-Za-z0-9_])(?:{inner})(?![A-Za-z0-9_])"


def audit(texts: DataFrame, key: str, text: str, norms: DataFrame, retired_only: bool = True) -> DataFrame:
    """(key, found, norm_id, superseded_by, migration, authority): names, as a rule the retired ones, that stand in a text as words.

    One pattern of all names reads each text once; only texts in which it finds any are asked which
    names they contain, and these are joined by name. The names are a dimension of at most
    ``MOST_NAMES``; a larger one is joined by words that a text and a name share.
    """
    known = norm_names(norms)
    retired = (known.filter("is_retired") if retired_only else known).join(migrations(norms).drop("norm_id"), "name", "left")
    rows = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [r["name"] for r in retired.select("name").limit(MOST_NAMES + 1).collect()]
    if not names:
        return rows.limit(0).select(F.col("key").alias(key), *[F.lit(None).cast("string").alias(c) for c in ("found", "norm_id", "superseded_by", "migration", "authority")])
    if len(names) <= MOST_NAMES:
        some = rows.filter(F.col("text").rlike(_any_of(names))).withColumn("low", F.lower("text"))
        held = some.select("key", "text", F.explode(F.filter(F.array(*[F.lit(n) for n in sorted(names)]), lambda n: F.col("low").contains(n))).alias("name"))
        hits = held.join(F.broadcast(retired), "name")
    else:
        word = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
        first = retired.withColumn("word", F.get(word(F.col("name")), F.lit(0)))
        hits = rows.select("key", "text", F.explode(word(F.col("text"))).alias("word")).join(first, "word").unionByName(rows.join(first.filter("word IS NULL"), F.lit(True)), allowMissingColumns=True)
    hits = hits.filter(F.regexp_like("text", _bounded_name(F.col("name"))))
    return hits.select(F.col("key").alias(key), F.col("name").alias("found"), "norm_id", "superseded_by", "migration", "authority")


def search(norms: DataFrame, queries: DataFrame, query: str = "query", limit: int = 5) -> DataFrame:
    """(query, id, score, rank): a point for each term of over two letters in a norm's text, three for the whole query."""
    array = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    names = F.concat(F.array("current"), array(F.col("aliases")), array(F.transform("supersedes", lambda s: s["name"])))
    hay = F.lower(F.concat_ws(" ", "id", "current", "authority", "notes", F.array_join(names, " ")))
    texts = norms.select("id", "ord", hay.alias("hay"))
    q = F.lower(F.trim(F.col(query)))
    asked = queries.select(F.col(query).alias("query"), q.alias("q")).distinct()
    asked = asked.withColumn("terms", F.filter(F.split("q", r"[^a-z0-9_]+"), lambda t: F.length(t) > 2))
    pairs = asked.join(F.broadcast(texts)) if norms.count() <= MOST_NAMES else asked.join(texts)
    score = F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.when(F.expr("hay").contains(t), 1.0).otherwise(0.0)) + F.when((F.col("q") != "") & F.col("hay").contains(F.col("q")), 3.0).otherwise(0.0)
    scored = pairs.select("query", "id", "ord", score.alias("score")).filter("score > 0")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("ord")
