"""All similar pairs between set-valued records, within one table or between two, by an extended-prefix join.

Equal sets are one class; only classes are joined. The tokens of a set are put in order of rising
document frequency. If two sets reach the similarity, then for every l up to the overlap they need,
the l rarest tokens that they share stand in the first ``size - need + l`` tokens of both (the
l-prefix). One shared prefix token is enough to make a candidate while few sets have it; where many
have it, the prefix is made longer and the sets must share that token and a further one, and so on:
each key is a combination of the l rarest shared tokens, with l as small as the key's own frequency
allows. Keys that stay frequent are joined in slices. Every row carries a sketch of its whole set,
the parity of its tokens over 128 bits; two sketches differ in no more bits than the sets in tokens,
so a pair whose sketches differ too much is dropped in the join. What is left is verified on whole sets.

Sets are handled as 64-bit hashes of their tokens; two different tokens of one hash would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from notewright.session import cut

#: A combination that more sets have than this is extended by one more token. Comparing two sketches in a join costs far less than a further row.
POSTINGS = 512
#: Longest combination; what is still frequent then is joined in slices of so many sets.
MAX_TOKENS, SLICE = 4, 1024
#: So many of the most frequent tokens have their frequencies sent to all tasks; rarer ones are put before them, in order of their hash.
RANKED = 1 << 16
#: Up to so many classes, the candidates' are sent to the tasks that hold the sets.
SENT = 1 << 18


def tag_set(tags: Column) -> Column:
    """Tags trimmed, freed of leading # and blanks, lower-cased, each run of space, _ or - one -."""
    clean = F.transform(
        tags,
        lambda t: F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(t, r"^[\s\p{Z}#]+", ""), r"[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "-"),
    )
    return F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    """The distinct runs of a-z and 0-9 in the lower-cased text."""
    return F.array_distinct(_words(text))


def hashed_sets(records: DataFrame, key: str, values: str, least_size: int) -> DataFrame:
    """(key, c, d, values): the tokens of each record's set as sorted hashes; c and d, 128 bits, name the set.

    Records whose key or set is null, or whose set has fewer than ``least_size`` tokens, are left out.
    """
    tokens = F.transform(F.filter(F.col(values), lambda v: v.isNotNull()), lambda v: F.xxhash64(v))
    rows = records.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(tokens)).alias("values"))
    rows = rows.filter((F.size("values") >= max(least_size, 1)) & F.col("key").isNotNull())
    return rows.select("key", F.xxhash64("values").alias("c"), F.xxhash64(F.lit(7), F.reverse("values")).alias("d"), "values")


def ranked_tokens(rows: DataFrame, most: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, frequencies) of the ``most`` most frequent tokens, sorted by hash; ties by hash."""
    counts = rows.select(F.explode("values").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    top = counts.orderBy(F.desc("df"), "h").limit(most).toPandas().sort_values("h")
    return top["h"].to_numpy(dtype=np.int64), top["df"].to_numpy(dtype=np.int64)


def _need(share: float, size: Column | np.ndarray) -> Column | np.ndarray:
    """ceil(share * size); 1e-9: a product like 0.6 * 5 must not exceed 3 by rounding."""
    if isinstance(size, np.ndarray):
        return np.ceil(size * share - 1e-9).astype(np.int64)
    return F.ceil(size * F.lit(share) - F.lit(1e-9)).cast("int")


def _prefix_batches(threshold: float, longest: int, ranks: tuple[np.ndarray, np.ndarray]):
    """Of each set the prefix tokens, rarest first, the size and the sketch."""
    known, frequency = ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            flat = np.asarray(lists.flatten())
            sizes = np.diff(np.asarray(lists.offsets))
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            df = np.zeros(len(flat), dtype=np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                df = np.where(known[place] == flat, frequency[place], 0)
            order = np.lexsort((flat, df, owner))
            keep = np.minimum(sizes, sizes - _need(threshold, sizes) + longest)
            chosen = order[np.arange(len(flat)) - starts[owner] < keep[owner]]
            toks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype(np.int32)), pa.array(flat[chosen]))
            bits = flat.view(np.uint64)
            one = np.uint64(1) << (bits & np.uint64(63))
            low = (bits >> np.uint64(6)) & np.uint64(1) == 0
            sketch = [np.bitwise_xor.reduceat(np.where(part, one, np.uint64(0)), starts).view(np.int64) for part in (low, ~low)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), toks, pa.array(sketch[0]), pa.array(sketch[1])], names=["c", "d", "size", "toks", "x", "y"])

    return run


_ROW = ("c", "d", "size", "x", "y")


def _matches(index: DataFrame, probe: DataFrame, on: list[str], length: int, threshold: float, sides: list[str]) -> DataFrame:
    """Candidates (ca, da, cb, db): an index row's set comes before the probe row's in order of size and name."""
    s = index.select(*on, *[F.col(n).alias(f"s_{n}") for n in (*_ROW, "at", *sides)])
    r = probe.select(*on, *[F.col(n).alias(f"r_{n}") for n in (*_ROW, "at", *sides)])
    ns, nr = F.col("s_size"), F.col("r_size")
    by_name = (F.col("s_c") < F.col("r_c")) | ((F.col("s_c") == F.col("r_c")) & (F.col("s_d") < F.col("r_d")))
    before = (ns < nr) | ((ns == nr) & by_name)
    alike = ns >= nr * threshold - 1e-9
    need = _need(threshold / (1 + threshold), ns + nr)
    # what the tokens after the key's last one can still give must reach the overlap the pair needs
    reach = F.least(ns - F.col("s_at"), nr - F.col("r_at")) + (length - 1) >= need
    apart = F.bit_count(F.col("s_x").bitwiseXOR(F.col("r_x"))) + F.bit_count(F.col("s_y").bitwiseXOR(F.col("r_y")))
    keep = before & alike & reach & (apart <= ns + nr - 2 * need)
    if sides:
        keep = keep & ((F.col("s_in_left") & F.col("r_in_right")) | (F.col("s_in_right") & F.col("r_in_left")))
    pairs = s.join(r, on).filter(keep)
    pick = lambda x, y: [F.when(by_name, F.col(f"s_{n}")).otherwise(F.col(f"r_{n}")).alias(f"{n}a") for n in x] + [F.when(by_name, F.col(f"r_{n}")).otherwise(F.col(f"s_{n}")).alias(f"{n}b") for n in y]
    return pairs.select(*pick("cd", "cd"))


def candidates(sets: DataFrame, threshold: float, postings: int, max_tokens: int, sides: list[str]) -> DataFrame:
    """Candidate pairs of classes; ``sets`` has c, d, size, toks, x, y.

    Of a pair the smaller set is on the index side, where its prefix is the shorter one, the larger on
    the probe side. A key is frequent if more than ``postings`` index rows have it; only then are the
    rows with that key, on both sides, extended by one more token of the longer prefix.
    """
    own, any_ = 2 * threshold / (1 + threshold), threshold  # least overlap with a partner that is not smaller, with any partner
    kept = [*_ROW, *sides]

    def first(share: float) -> DataFrame:
        n = F.col("size") - _need(share, F.col("size")) + 1
        return sets.select(*kept, F.posexplode(F.slice("toks", F.lit(1), n)).alias("at", "key"))

    def longer(rows: DataFrame, share: float, length: int) -> DataFrame:
        """Keys of one more token: each later one of the prefix for ``length`` tokens."""
        more = rows.select("c", "d", "key", "at").join(sets, ["c", "d"])
        rest = F.slice("toks", F.col("at") + 2, F.greatest(F.lit(0), F.col("size") - _need(share, F.col("size")) + length - F.col("at") - 1))
        more = more.select(*kept, "key", "at", F.posexplode(rest).alias("step", "h"))
        return more.select(*kept, (F.col("at") + 1 + F.col("step")).alias("at"), F.xxhash64("key", "h").alias("key"))

    index, probe, found = first(own), first(any_), None
    for length in range(1, max_tokens + 1):
        often = cut(index.groupBy("key").agg(F.count("*").alias("times")).filter(f"times > {postings}").select("key", F.ceil(F.col("times") / SLICE).cast("int").alias("slices")))
        some = not often.isEmpty()
        seldom = index.join(often, "key", "left_anti") if some else index
        pairs = _matches(seldom, probe, ["key"], length, threshold, sides)
        found = pairs if found is None else found.unionByName(pairs)
        if not some:
            break
        index, probe = index.join(often, "key"), probe.join(often, "key")
        # a set that needs no more shared tokens than the key has cannot be asked for another
        stay = F.lit(length == max_tokens) | (_need(own, F.col("size")) <= length)
        ready = index.filter(stay).withColumn("slice", F.pmod(F.col("c"), "slices").cast("int"))
        asked = probe.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        found = found.unionByName(_matches(ready, asked, ["key", "slice"], length, threshold, sides))
        if length < max_tokens:
            index, probe = longer(index.filter(~stay), own, length + 1), longer(probe, any_, length + 1)
    return found.distinct()


def similar_sets(rows: DataFrame, threshold: float, postings: int = POSTINGS, max_tokens: int = MAX_TOKENS, sides: DataFrame | None = None) -> DataFrame:
    """(ca, da, cb, db): pairs of different sets with intersection / union >= threshold, each once.

    ``rows`` come from ``hashed_sets``. ``sides`` (c, d, in_left, in_right) asks only for pairs between two tables.
    """
    prefixes = rows.select("c", "d", "values").mapInArrow(_prefix_batches(threshold, max_tokens, ranked_tokens(rows)), "c long, d long, size int, toks array<long>, x long, y long")
    sets = prefixes.dropDuplicates(["c", "d"])
    if sides is not None:
        sets = sets.join(sides, ["c", "d"])
    near = cut(candidates(cut(sets), threshold, postings, max_tokens, ["in_left", "in_right"] if sides is not None else []))
    ids = near.select(F.col("ca").alias("c"), F.col("da").alias("d")).unionByName(near.select(F.col("cb").alias("c"), F.col("db").alias("d"))).distinct()
    ids = cut(ids)
    held = rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, ["c", "d"], "left_semi").dropDuplicates(["c", "d"]).select("c", "d", "values")
    both = near.join(held.toDF("ca", "da", "va"), ["ca", "da"]).join(held.toDF("cb", "db", "vb"), ["cb", "db"])
    shared = F.size(F.array_intersect("va", "vb"))
    return both.filter(shared >= (F.size("va") + F.size("vb") - shared) * F.lit(threshold) - 1e-9).select("ca", "da", "cb", "db")


def similar_pairs(records: DataFrame, key: str, values: str, threshold: float, least_size: int = 1, **params: int) -> DataFrame:
    """(a, b): keys of all pairs of records, a < b, whose sets overlap by ``threshold`` or more.

    Defined cases: null sets, null members and sets under ``least_size`` form no pair; repeated
    members count once; records with equal sets pair with one another; several rows with one key
    and one set are one record, with different sets each set counts; other columns are not read; an
    empty table gives an empty result. Use ``class_links`` where groups of equal sets are large and
    pairs of classes plus membership are wanted instead of all pairs.
    """
    rows = cut(hashed_sets(records, key, values, least_size))
    near = similar_sets(rows, threshold, **params)
    members = rows.select("c", "d", "key").distinct()
    of_a, of_b = members.toDF("ca", "da", "ka"), members.toDF("cb", "db", "kb")
    across = near.join(of_a, ["ca", "da"]).join(of_b, ["cb", "db"]).select("ka", "kb")
    within = of_a.join(of_b, (F.col("ca") == F.col("cb")) & (F.col("da") == F.col("db")) & (F.col("ka") < F.col("kb"))).select("ka", "kb")
    pairs = across.unionByName(within).filter("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def similar_between(left: DataFrame, left_key: str, left_values: str, right: DataFrame, right_key: str, right_values: str, threshold: float, least_size: int = 1, **params: int) -> DataFrame:
    """(a, b): keys of all pairs of a record of ``left`` and one of ``right`` whose sets overlap by ``threshold`` or more.

    The keys of the two tables may have different types; see ``similar_pairs`` for the defined cases.
    """
    sides = [cut(hashed_sets(df, k, v, least_size)) for df, k, v in ((left, left_key, left_values), (right, right_key, right_values))]
    rows = sides[0].select("c", "d", "values").unionByName(sides[1].select("c", "d", "values"))
    named = [s.select("c", "d", F.lit(n == 0).alias("in_left"), F.lit(n == 1).alias("in_right")) for n, s in enumerate(sides)]
    where = named[0].unionByName(named[1]).groupBy("c", "d").agg(F.bool_or("in_left").alias("in_left"), F.bool_or("in_right").alias("in_right"))
    near = similar_sets(rows, threshold, sides=where, **params)
    a, b = (s.select("c", "d", "key").distinct() for s in sides)
    equal = a.toDF("c", "d", "a").join(b.toDF("c", "d", "b"), ["c", "d"]).select("a", "b")
    ways = [near.join(a.toDF(f"c{x}", f"d{x}", "a"), [f"c{x}", f"d{x}"]).join(b.toDF(f"c{y}", f"d{y}", "b"), [f"c{y}", f"d{y}"]).select("a", "b") for x, y in ("ab", "ba")]
    return equal.unionByName(ways[0]).unionByName(ways[1]).distinct()


def class_links(records: DataFrame, key: str, values: str, threshold: float, least_size: int = 1, **params: int) -> tuple[DataFrame, DataFrame]:
    """(members: class, key), (links: a, b): classes of equal sets, named by their least key, and the pairs of similar classes.

    Keys are unique here.
    """
    rows = cut(hashed_sets(records, key, values, least_size))
    near = cut(similar_sets(rows, threshold, **params))
    names = rows.groupBy("c", "d").agg(F.min("key").alias("class"))
    members = rows.select("c", "d", "key").join(names, ["c", "d"]).select("class", "key").distinct()
    links = near.join(names.toDF("ca", "da", "a"), ["ca", "da"]).join(names.toDF("cb", "db", "b"), ["cb", "db"])
    return members, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: Facets of notes: how the set is made, threshold, least size.
FACETS = {"tags": (lambda: tag_set(F.col("tags")), 0.6, 3), "content": (lambda: _words(F.col("content")), 0.75, 30)}


def note_facet(notes: DataFrame, facet: str) -> tuple[DataFrame, float, int]:
    made, threshold, least = FACETS[facet]
    return notes.select("note_id", made().alias("values")), threshold, least


def note_pairs(notes: DataFrame, facet: str) -> DataFrame:
    """(note_id_a, note_id_b) of one facet of notes."""
    rows, threshold, least = note_facet(notes, facet)
    pairs = similar_pairs(rows, "note_id", "values", threshold, least)
    return pairs.select(F.col("a").alias("note_id_a"), F.col("b").alias("note_id_b"))


def linked_classes(notes: DataFrame, facet: str) -> DataFrame:
    """(facet, note_id, class_id, copies, links): membership instead of all pairs.

    ``copies`` counts the notes with the same set, ``links`` the other sets that are similar; pairs
    are never expanded, so a set that a third of all notes share stays one class.
    """
    rows, threshold, least = note_facet(notes, facet)
    members, near = class_links(rows, "note_id", "values", threshold, least)
    ends = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class")))
    links = ends.groupBy("class").agg(F.count("*").alias("links"))
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    out = members.join(copies, "class").join(links, "class", "left")
    return out.select(F.lit(facet).alias("facet"), F.col("key").alias("note_id"), F.col("class").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
