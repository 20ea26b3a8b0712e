"""Personal information in free text: bootstrapped contextual extraction and typed placeholders.

Candidates (capitalised words, long numbers, street-like spans) come with the lexical patterns
they stand in: the words to the left and right, their shape or affixes. Candidates and patterns
form a bipartite graph. Known values seed it: listed name parts and the known values of each
encounter. Spark then scores it in rounds: a pattern by the share of its distinct candidates that
are believed personal, a candidate by the mean of its patterns. Candidates over the threshold
join the lexicon, so confident patterns discover identifiers that no list holds. At last each
text is read once more with the accepted parts that occur in it, and whole spans are assembled.
E-mail addresses have a form of their own and need no scoring.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame, functions as F, types as T

from notewright.session import cut, spread

KINDS = ("name", "email", "phone", "national_id", "address")
#: Most rounds of scoring, belief from which a candidate is accepted, trust from which a title alone makes a name of the word after it.
ROUNDS = 5
ACCEPT, TITLED = 0.5, 0.3
#: Candidates and patterns of more edges are parted in joins, into so many parts.
HOT, SALTS = 50_000, 16
FIELDS = ("transcription", "clinical_note")
#: Shorter numbers are measurements, days and times.
LEAST_DIGITS = 6

_WORD = re.compile(r"\p{L}[\p{L}\p{M}'’]*")
_CAPS = re.compile(r"(?<![\p{L}\p{N}_@.+-])\p{Lu}[\p{L}\p{M}'’]+(?:-\p{L}[\p{L}\p{M}'’]+)?(?![\p{L}\p{N}_@])")
_NUMBER = re.compile(r"(?<![\p{L}\p{N}_.,:/+-])(?:\+ ?)?(?:\(\d{1,5}\)|\d+)(?:[ .-]?(?:\(\d{1,4}\)|\d+)|\+(?=\d{4}\b)\d+)*(?![\p{L}\p{N}_/]|[:,.]\d)")
EMAIL = re.compile(
    r"(?i)(?<![\w.+-])[\p{L}\d][\p{L}\d_.+-]*(?:\s?@\s?|\s?[\[({]\s?(?:at|snabel-?a)\s?[\])}]\s?)[\p{L}][\p{L}\d-]*(?:(?:\.|\s?[\[({]?\bdot\b[\])}]?\s?)[\p{L}][\p{L}\d-]*)+"
    r"|(?<![\w.+-])[\p{L}\d][\p{L}\d_.+-]*\sat\s[\p{L}][\p{L}\d-]*(?:\sdot\s[\p{L}][\p{L}\d-]*)+"
)
_UNIT = r"\d{1,4}(?: ?[A-H](?![\p{L}\d])|[a-h](?![\p{L}\d]))?(?![\p{L}\d]|[.,:/-]\d)"
#: Street-like: words then a number, or a number then words; the last word tells whether it is a street.
_AFTER = re.compile(rf"(?<![\p{{L}}\p{{N}}_-])(?:(\p{{L}}[\p{{L}}\p{{M}}]+) )?(\p{{L}}[\p{{L}}\p{{M}}]{{2,}}\.?) ({_UNIT})")
_BEFORE = re.compile(r"(?<![\p{L}\p{N}_.,:/+-])\d{1,4}(?:[A-Ha-h]|(?: [A-H]))?((?: \p{L}[\p{L}\p{M}]+){2,4})")
#: Words that alone name a kind of street after the street's own name, and endings of street names.
STREET_WORDS = "street st road rd lane ln avenue ave close drive way terrace court place square crescent gränd gata gatan väg vägen stig stigen torg torget allé allén weg straße strasse platz gasse".split()
STREET_ENDINGS = "gatan vägen stigen torget gränd allén straße strasse".split()
#: Written apart from the street's own name, in lower case.
_APART = {"gränd", "gata", "gatan", "väg", "vägen", "stig", "stigen", "torg", "torget", "allé", "allén", "weg", "straße", "strasse", "platz", "gasse"}
_TITLES = {"dr", "mr", "mrs", "ms", "doctor", "doktor", "prof", "professor", "sister", "syster", "miss"}
_LEFT = re.compile(r"[\p{L}'’-]+\.?|\d+|[:,;(<|>]|[.!?](?=\s|$)")
_RIGHT = re.compile(r"[\p{L}'’-]+|\d+|[:,;)>.|]")
_NOISE = re.compile(r"(?i)\[[^\]\n]{1,40}\]|\(\(?[^()\n]{1,40}\)\)?|<[^<>@\n]{1,40}>|\{[^{}\n]{1,40}\}|\*+|\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?|(?<!\S)(?:u+h*m*|e+h?m*|e?rm+|er|h+m+|mm+|ö+h+)(?:\.\.\.|,)?(?!\S)")


def _context(text: str, start: int, end: int, noise: list[tuple[int, int]]) -> tuple[str, str, str]:
    """Last word, last two words to the left, next word to the right; names in capitals become ``<C>``.

    ``noise`` has the spans of sounds and times in the text, in order; what stands before and behind
    them is the candidate's neighbour.
    """
    n = bisect_left(noise, (start - 70, 0))
    clean = not (n < len(noise) and noise[n][0] < end + 40) and not (n and noise[n - 1][1] > start - 70)
    words = _LEFT.findall(text, max(0, start - 32), start) if clean else []
    if len(words) < 3:  # the first of three may be cut
        left = text[max(0, start - 70) : start]
        words = _LEFT.findall(left if clean else _NOISE.sub(" ", left))
    words = words[-2:]
    right = text[end : end + 40]
    after = _RIGHT.search(right if clean else _NOISE.sub(" ", right))

    def plain(w: str) -> str:
        if w[0].isdigit():
            return "<9>"
        low = w.lower().rstrip(".") if len(w) > 1 else w
        return "<C>" if w[0].isupper() and len(w) > 4 and low not in _TITLES and not w.endswith(".") and len(words) > 1 and w != words[0] else low

    marked = [plain(w) for w in words]
    return (marked[-1] if marked else "^", " ".join(marked) if len(marked) == 2 else "^", plain(after.group()) if after else "$")


def _real_day(digits: str) -> bool:
    """Whether digits begin with a calendar day as YYMMDD or YYYYMMDD (a day + 60 is a coordination number)."""
    y, m, d = (int(digits[:4]), digits[4:6], digits[6:8]) if len(digits) == 12 else (2000 + int(digits[:2]), digits[2:4], digits[4:6])
    try:
        date(y, int(m), (int(d) - 1) % 60 + 1 if int(d) > 60 else int(d))
        return len(digits) != 12 or 1850 <= y <= 2100
    except ValueError:
        return False


def shape(number: str) -> str:
    """Digits as 9 but for a leading zero, other characters kept, and whether a birth day begins it."""
    digits = re.sub(r"\D", "", number)
    out = re.sub(r"[1-9]", "9", number[:1]) + re.sub(r"\d", "9", number[1:])
    return out + ("|day" if len(digits) in (10, 12) and _real_day(digits) else "")


def outline(number: str) -> str:
    """How a number begins, how many digits it has, and whether a birth day begins it."""
    digits = re.sub(r"\D", "", number)
    day = "|day" if shape(number).endswith("|day") else ""
    return f"{re.sub('[1-9]', '9', number[:1])}{len(digits)}{day}"


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if sum(c.isdigit() for c in m.group()) >= LEAST_DIGITS:
            yield a, b


def _streets(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, street word) of street-like spans."""
    for m in _AFTER.finditer(text):
        word = m.group(2).rstrip(".").lower()
        if word in _APART and not m.group(1):
            continue
        yield (m.start(1) if word in _APART else m.start(2)), m.end(), word
    for m in _BEFORE.finditer(text):
        words = m.group(1).split(" ")[1:]
        end = m.start(1) + 1 + len(words[0])
        for word in words[1:]:
            end += 1 + len(word)
            low = word.lower()
            yield m.start(), end + (low == "ave" and text[end : end + 1] == "."), low


_AT = re.compile(r"(?i)[\[({]\s?(?:at|snabel)")


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of e-mail addresses; texts without any form of @ are not searched."""
    return [m.span() for m in EMAIL.finditer(text)] if "@" in text or "dot" in text.lower() or _AT.search(text) else []


def _candidates(text: str) -> Iterator[tuple[str, str, str]]:
    """(class, value, pattern) of every candidate of a text."""
    masked = _emails(text)
    noise = [m.span() for m in _NOISE.finditer(text)]
    inside = lambda a, b: any(x < b and a < y for x, y in masked)

    def around(a: int, b: int) -> list[str]:
        left, two, right = _context(text, a, b, noise)
        return [f"L {left}", f"M {two}", f"R {right}"]

    for a, b in _numbers(text):
        if not inside(a, b):
            masked.append((a, b))
            value = text[a:b]
            for p in (f"H {shape(value)}", f"H {outline(value)}", *around(a, b)):
                yield "number", value, p
    for a, b, word in _streets(text):
        if not inside(a, b):
            for p in (*(f"E{n} {word[-n:]}" for n in (3, 4, 5, 6) if len(word) >= n), f"E0 {word}", *around(a, b)):
                yield "street", word, p
            if word in STREET_WORDS or any(word.endswith(e) for e in STREET_ENDINGS):
                masked.append((a, b))
    for m in _CAPS.finditer(text):
        a, b = m.span()
        if inside(a, b):
            continue
        parts = m.group().lower().split("-")
        ctx = around(a, b)
        for value in parts:
            affixes = [f"S{n} {value[-n:]}" for n in (3, 4) if len(value) > n] + ([f"P4 {value[:4]}"] if len(value) > 4 else [])
            for p in (*affixes, *ctx):
                yield "word", value, p


def _graph_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for text in batch.column(0).to_pylist() for r in set(_candidates(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["class", "value", "pattern"])


def texts_of(transcriptions: DataFrame) -> DataFrame:
    """(id, field_name, text), each once."""
    both = [transcriptions.select("id", F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS]
    return both[0].unionByName(both[1]).filter(F.col("text").rlike(r"\S")).dropDuplicates(["id", "field_name", "text"])


def _scan(text: Column) -> Column:
    """The text as it is read: line ends that are still escaped become blanks of equal length."""
    return F.when(text.contains("\n"), text).otherwise(F.regexp_replace(text, r"\\[nrt]", "  "))


def seeds(patterns: DataFrame, person_names: DataFrame) -> DataFrame:
    """(class, value, label): what is known before the first round."""
    part = F.lower(F.trim("part_of_name"))
    listed = person_names.select(F.explode(F.split(F.lower(F.trim("name")), r"[\s-]+")).alias("value"), part.alias("label"))
    known = patterns.select(F.lower(F.trim("pii_type")).alias("kind"), F.trim("pattern").alias("p")).filter(F.length("p") >= 2)
    numbers = known.filter(F.col("kind").isin("phone", "national_id")).select(F.lit("number").alias("class"), F.col("p").alias("value"), F.col("kind").alias("label"))
    streets = known.filter("kind = 'address'").select(
        F.lit("street").alias("class"),
        F.lower(F.when(F.col("p").rlike(r"^\d"), F.regexp_extract("p", r"(\p{L}+)\.?$", 1)).otherwise(F.regexp_extract("p", r"(\p{L}+)\.? \d", 1))).alias("value"),
        F.lit("address").alias("label"),
    )
    # "Given Family", "Family, Given": the parts of known names
    whole = known.filter("kind = 'name' AND p RLIKE '^\\\\p{L}{2,}( \\\\p{L}\\\\.)?,? \\\\p{L}{2,}(-\\\\p{L}{2,})?$'")
    ends = F.split(F.lower("p"), r",? (?:\p{L}\. )?")
    turned = F.col("p").contains(",")
    pair = F.array(
        F.struct(F.when(turned, F.element_at(ends, -1)).otherwise(ends[0]).alias("value"), F.lit("given").alias("label")),
        F.struct(F.when(turned, ends[0]).otherwise(F.element_at(ends, -1)).alias("value"), F.lit("family").alias("label")),
    )
    named = whole.select(F.explode(pair).alias("x")).select(F.explode(F.split("x.value", "-")).alias("value"), "x.label")
    names = listed.unionByName(named).select(F.lit("word").alias("class"), "value", "label")
    fixed = patterns.sparkSession.createDataFrame([("street", w, "address") for w in STREET_WORDS], "class string, value string, label string")
    out = names.unionByName(numbers).unionByName(streets).unionByName(fixed)
    return out.filter("value <> '' AND label IN ('given', 'family', 'phone', 'national_id', 'address')").distinct()


def _salted(rows: DataFrame, few: DataFrame, on: str, by: str, hot: str) -> DataFrame:
    """``rows`` joined with the few rows that ``few`` has of each key; frequent keys (``hot`` in both) are parted by ``by``."""
    spread_out = rows.withColumn("salt", F.when(F.col(hot), F.pmod(F.col(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop(hot)
    copies = few.withColumn("salt", F.explode(F.when(F.col(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(hot)
    return spread_out.join(copies, [on, "salt"]).drop("salt")


def score_graph(edges: DataFrame, known: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """(class, value, label, score): belief in each candidate, and (class, pattern, label, trust) of the last round.

    ``edges`` are (class, value, pattern), each once. Seeds keep score 1. Both steps are grouped
    sums, combined before the shuffle, over 64-bit ids of candidates and patterns; ids that many edges
    have are parted in the joins, so a pattern that a third of all candidates share is no hot task.
    Scoring ends after ``rounds``, or before if the number of accepted candidates and their scores stay.
    Between rounds only the scores are written.
    """
    ids = edges.select("class", "value", "pattern", F.xxhash64("class", "value").alias("v"), F.xxhash64("class", "pattern").alias("p"))
    breadth = ids.groupBy("p").agg(F.count("*").alias("n"))
    # affixes and shapes count as much together as the surroundings; none that is shared is no evidence
    inner = F.col("pattern").rlike("^[HSPE]")
    linked = ids.select("v", "p", inner.alias("inner"), F.col("pattern").rlike("^[LM]").alias("before"), (F.col("class") == "number").alias("number")).join(breadth.filter("n > 1"), "p")
    breadths = linked.groupBy("v").agg(F.count_if("inner").alias("n_in"), F.count_if(~F.col("inner")).alias("n_out"), F.first("number").alias("number"), (F.count("*") > HOT).alias("hot_v"))
    breadths = cut(breadths)
    linked = cut(linked.join(breadths.select("v", "hot_v"), "v").withColumn("hot_p", F.col("n") > HOT).drop("number"))
    seeded = cut(known.select(F.xxhash64("class", "value").alias("v"), "label", F.lit(1.0).alias("score")).join(ids.select("v").distinct(), "v", "left_semi"))
    belief, before = seeded, None
    for _ in range(rounds):
        told = belief.join(breadths.select("v", "hot_v"), "v")
        heard = _salted(linked.select("v", "p", "n", "hot_v"), told, "v", "p", "hot_v").groupBy("p", "label").agg((F.sum("score") / (F.max("n") + 1)).alias("trust"), (F.max("n") > HOT).alias("hot_p"))
        heard = cut(heard)
        within, around = F.when(F.col("inner"), F.col("trust")), F.when(~F.col("inner"), F.col("trust"))
        sums = _salted(linked.select("v", "p", "inner", "before", "hot_p"), heard, "p", "v", "hot_p").groupBy("v", "label").agg(
            F.sum(F.coalesce(within, F.lit(0.0))).alias("t_in"), F.sum(F.coalesce(around, F.lit(0.0))).alias("t_out"), F.coalesce(F.max(F.when(F.col("before"), F.col("trust"))), F.lit(0.0)).alias("top_out")
        )
        t_in, t_out = F.col("t_in") / F.greatest("n_in", F.lit(1)), F.col("t_out") / F.greatest("n_out", F.lit(1))
        # a number's form and the best of what stands before it must both speak for it
        score = F.when(F.col("number"), F.sqrt(t_in * F.col("top_out"))).otherwise((t_in + t_out) / 2)
        found = sums.join(breadths, "v").select("v", "label", "number", score.alias("score"))
        # confident numbers count in full in the next round
        found = found.select("v", "label", F.when(F.col("number") & (F.col("score") >= accept), F.lit(1.0)).otherwise(F.col("score")).alias("score"))
        belief = cut(found.unionByName(seeded).groupBy("v", "label").agg(F.max("score").alias("score")))
        now = belief.agg(F.count_if(F.col("score") >= accept).alias("n"), F.round(F.sum("score"), 3).alias("s")).first()
        if now == before:
            break
        before = now
    names = edges.select("class", "value", F.xxhash64("class", "value").alias("v")).distinct()
    scored = belief.filter(F.col("score") >= accept).join(names, "v").select("class", "value", "label", "score")
    spoken = edges.filter("class = 'word'").select("class", "pattern", F.xxhash64("class", "pattern").alias("p")).filter(F.col("pattern").isin(*[f"L {t}" for t in sorted(_TITLES)])).distinct()
    return scored, heard.join(F.broadcast(spoken), "p").select("class", "pattern", "label", "trust")  # at most one row a title


def lexicon(texts: DataFrame, patterns: DataFrame, person_names: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> tuple[DataFrame, set[str]]:
    """(class, value, label, score) of the accepted parts: for each value the label with the most belief; and the titles that names follow."""
    edges = texts.select(_scan(F.col("text")).alias("text")).mapInArrow(_graph_batches, "class string, value string, pattern string").distinct()
    edges = cut(edges)
    ends = edges.filter((F.col("class") == "street") & F.col("value").rlike("(" + "|".join(STREET_ENDINGS) + ")$"))
    known = seeds(patterns, person_names).unionByName(ends.select("class", "value", F.lit("address").alias("label"))).distinct()
    scored, trusted = score_graph(edges, known, rounds, accept)
    best = scored.groupBy("class", "value").agg(F.max(F.struct("score", "label")).alias("b"))
    titles = trusted.groupBy("pattern").agg(F.sum("trust").alias("trust")).filter(F.col("trust") >= TITLED).collect()  # of the fixed list of titles
    return best.select("class", "value", "b.label", "b.score"), {r["pattern"][2:] for r in titles}


_PARTS = re.compile(r"\p{L}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}'’]*)*")
_TITLE_BEFORE = re.compile(r"(?<![\p{L}\p{N}])(?i:dr|mr|mrs|ms|doctor|doktor|prof)\.?\s+$")
_AFTER_TITLE = re.compile(r"(?<![\p{L}\p{N}])(Dr|dr|Mr|Mrs|Ms)\.?\s{1,6}(\p{Lu}[\p{L}\p{M}'’]{2,}(?:-\p{Lu}[\p{L}\p{M}'’]+)?)")
_SIGN_AFTER = re.compile(r"(?i)\s+(?:sign|disease|test|tecken|sjukdom|syndrome|pattern|\p{L}+ sign)\b")


def _titled(text: str, at: int) -> bool:
    """Whether a title stands before, hesitations and sounds between them left out."""
    return bool(_TITLE_BEFORE.search(_NOISE.sub(" ", text[max(0, at - 60) : at])))


def _name_spans(text: str, roles: dict[str, str], taken: list[tuple[int, int]], titles: frozenset[str] | set[str]) -> Iterator[tuple[int, int]]:
    """Spans of whole names from the tokens of a text and the accepted parts among them, and words after trusted titles."""
    tokens = []
    for m in _PARTS.finditer(text):
        a, b = m.span()
        word = m.group()
        low = word.lower()
        if low not in roles and "-" not in low and b - a > 1:
            tokens.append((a, b, "T" if low in _TITLES else "-", word))
            continue
        if any(x < b and a < y for x, y in taken):
            continue
        parts = low.split("-")
        known = [roles.get(p) for p in parts]
        if b - a == 1 and word.isupper() and text[b : b + 1] == ".":
            kind, b = "I", b + 1
        elif all(known):
            kind = "F" if "family" in known or len(known) > 1 else "G"
        else:
            kind = "T" if low in _TITLES else "-"
        tokens.append((a, b, kind, word))
    i = 0
    while i < len(tokens):
        a, b, kind, word = tokens[i]
        if kind in "-T":
            i += 1
            continue
        j, kinds = i, [kind]
        comma = False
        while j + 1 < len(tokens):
            gap = text[tokens[j][1] : tokens[j + 1][0]]
            nxt = tokens[j + 1][2]
            if nxt in "GFI" and (re.fullmatch(r"\s{1,6}", gap) or (gap == "" and kinds[-1] == "I")) and not ("F" in kinds and not comma and nxt in "GF"):
                pass
            elif kinds == ["F"] and nxt == "G" and re.fullmatch(r",\s{1,6}", gap):
                comma = True
            else:
                break
            j += 1
            kinds.append(nxt)
        while kinds and kinds[-1] == "I" and not comma:
            kinds.pop()
            j -= 1
        if kinds and any(k in "GF" for k in kinds):
            end = tokens[j][1]
            titled = _titled(text, a)
            if titled or ("F" in kinds and len(kinds) > 1):
                yield a, end
            elif len(kinds) == 1 and word[0].isupper() and kind == "F" and not _SIGN_AFTER.match(text, end):
                yield a, end
        i = max(j, i) + 1
    for m in _AFTER_TITLE.finditer(text):
        if m.group(1).lower() in titles:
            yield m.span(2)


def spans(text: str, parts: list[tuple[str, str]], numbers: list[tuple[str, str]], streets: set[str], titles: frozenset[str] | set[str] = frozenset(_TITLES)) -> list[tuple[int, int, str]]:
    """(start, end, kind) without overlaps, in order: emails, numbers, addresses, names."""
    found: list[tuple[int, int, str]] = [(a, b, "email") for a, b in _emails(text)]
    free = lambda a, b: all(b <= x or y <= a for x, y, _ in found)
    label = dict(numbers)
    for a, b in _numbers(text):
        kind = label.get(text[a:b])
        if kind and free(a, b):
            found.append((a, b, kind))
    for a, b, word in _streets(text):
        if word in streets and free(a, b):
            found.append((a, b, "address"))
    roles = dict(parts)
    for a, b in sorted(_name_spans(text, roles, [f[:2] for f in found], titles), key=lambda s: s[0] - s[1]):
        if free(a, b):
            found.append((a, b, "name"))
    return sorted(found)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))


def _span_batches(titles: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, scans = (batch.column(n).to_pylist() for n in (2, 3, 4))
            out = []
            for text, parts, scan in zip(texts, held, scans):
                by = {"word": [], "number": [], "street": []}
                for p in parts or []:
                    by[p["class"]].append((p["value"], p["label"]))
                found = spans(scan, by["word"], by["number"], {v for v, _ in by["street"]}, titles)
                out.append([{"start": a, "end": b, "kind": k, "value": text[a:b]} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, _SPANS_ARROW)], names=["id", "field_name", "text", "spans"])

    return run


def _present(text: Column) -> Column:
    """What of a text may be in the lexicon: its words of two or more letters and its longer numbers."""
    parts = F.split(F.concat(F.lit(" "), F.lower(text)), r"[^\p{L}\p{M}'’]+[\p{M}'’]*")
    words = F.transform(F.array_distinct(F.filter(parts, lambda w: F.length(w) > 1)), lambda w: F.struct(F.lit("w").alias("type"), w.alias("value")))
    number = r"((?:\+ ?)?(?:\(\d{1,5}\)|\d+)(?:[ .-]?(?:\(\d{1,4}\)|\d+)|\+(?=\d{4}\b)\d+)*)"
    numbers = F.transform(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(number), F.lit(1))), lambda x: F.length(x) >= LEAST_DIGITS), lambda x: F.struct(F.lit("n").alias("type"), x.alias("value")))
    return F.concat(words, numbers)


def find_spans(transcriptions: DataFrame, patterns: DataFrame, person_names: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(id, field_name, text, spans): every text once with its personal spans (code point offsets).

    Defined cases: null and blank fields give no row; rows delivered twice count once; null ids are
    kept; blank, one-letter and stale known patterns seed nothing; overlaps go to e-mail, then
    number, address, name; a text without personal values has an empty list; other columns are not
    read; empty tables give an empty result (with empty lists the fixed street words still seed).
    """
    texts = cut(spread(texts_of(transcriptions), "id", "field_name"))
    accepted, titles = lexicon(texts, patterns, person_names, rounds, accept)
    accepted = cut(accepted)
    kind = F.when(F.col("class") == "number", F.lit("n")).otherwise(F.lit("w"))
    held = texts.select("id", "field_name", F.sha2("text", 256).alias("mark"), F.explode(_present(_scan(F.col("text")))).alias("x"))
    held = held.select("id", "field_name", "mark", "x.type", "x.value").join(accepted.select(kind.alias("type"), "value", "class", "label"), ["type", "value"])
    lists = held.groupBy(F.col("id").alias("i"), F.col("field_name").alias("f"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("class", "value", "label")).alias("parts"))
    joined = texts.join(lists, texts["id"].eqNullSafe(F.col("i")) & (texts["field_name"] == F.col("f")) & (F.sha2(texts["text"], 256) == F.col("m")), "left")
    kind_of_id = transcriptions.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind_of_id), T.StructField("field_name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", _SPANS)])
    return joined.select("id", "field_name", "text", "parts", _scan(F.col("text")).alias("scan")).mapInArrow(_span_batches(titles), schema)


def found_values(found: DataFrame) -> DataFrame:
    """(id, field_name, kind, found_value): each distinct value of a field once."""
    rows = found.select("id", "field_name", F.explode("spans").alias("s"))
    return rows.select("id", "field_name", F.col("s.kind").alias("kind"), F.col("s.value").alias("found_value")).distinct()


def redacted(found: DataFrame) -> DataFrame:
    """(id, field_name, redacted): each span replaced by its kind in brackets, the rest unchanged."""
    head = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"), F.lit("").alias("value"))), F.col("spans"))
    pieces = F.transform(
        F.arrays_zip(head.alias("x"), F.col("spans").alias("y")),
        lambda p: F.concat(
            F.when(p["x"]["kind"] == "", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(p["x"]["kind"]), F.lit("]"))),
            F.substring("text", p["x"]["end"] + 1, F.coalesce(p["y"]["start"], F.length("text")) - p["x"]["end"]),
        ),
    )
    return found.select("id", "field_name", F.array_join(pieces, "").alias("redacted"))
