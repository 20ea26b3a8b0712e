"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that carry no meaning for search.
STOP_WORDS = (
    "the a an of in on for for to and or is are was were be been with as at by from that "
    "this it its not no if then than into over under can may might will would should could "
    "do does did have has had but so such when while which who whom whose there here their "
    "his her they he she you i we"
).split()
#: Endings that are cut from words of more than four letters, the first that fits.
SUFFIXES = ("ies", "ing", "ed", "es", "s")

#: Numbers with a clinical unit.
NUMERIC_CLAIM = r"\b\d+(?:[.,]\d+)?\s*(?:mmol/L|mg/dL|mmHg|ms|mL/min|bpm|mg|%)\b"
#: Names of risk scores.
SCORE_NAME = r"CHA2DS2[-\w]*|CHADS\d?|HAS-?BLED|GRACE|TIMI|EuroSCORE|Wells"
#: Analytes whose bare number counts as a value.
ANALYTES = (
    "LDL|HDL|non-HDL|triglyceride|cholesterol|HbA1c|creatinine|eGFR|troponin|BNP|NT-proBNP|potassium|sodium|"
    "haemoglobin|hemoglobin|EF|LVEF|PASP|gradient|INR|CRP|TSH"
)
BARE_ANALYTE = rf"\b(?:{ANALYTES})\b[^.\n]{{0,40}}?\b\d+(?:[.,]\d+)?\b"
#: The same with word boundaries round score names and without the need of a letter after a per cent sign.
STRICT_NUMERIC_CLAIM = r"\b\d+(?:[.,]\d+)?\s*(?:(?:mmol/L|mg/dL|mmHg|ms|mL/min|bpm|mg)\b|%)"
STRICT_SCORE_NAME = rf"\b(?:{SCORE_NAME})\b"

#: Kinds of personal data and their patterns, in the order in which they are replaced.
SCRUB_PATTERNS = (
    ("personal-number", r"\b(?:19|20)?\d{6}[-+]?\d{4}\b"),
    ("phone", r"\b(?:\+46|0)\s?7[02369](?:[\s-]?\d){7}\b"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"),
    ("url", r"\bhttps?://\S+"),
    ("birth-date", r"(?i)(\b(?:f[oö]dd|f[oö]dt|born|f[oö].dsel)\b\s*:?\s*)(\d{4,6}[\s-]?\d{2,5}|\d{4}-\d{2}-\d{2})"),
    ("journal-id", r"(?i)\b(?:journal\s?nr|journalnummer|patient\s?id|person\s?nr|personnummer|ssn|mrn)\s*:?\s*\S*\d\S*"),
    ("street-address", r"(?i)\b\w+\s?(?:gatan?|vägen|väg|stig|gränd|torget)\s+\d+\b"),
    ("post-code", r"\b\d{3}\s?\d{2}\b"),
)
#: Closes what the fixed patterns miss: +46 at the start of a word, other mobile forms.
STRICT_PHONE = r"(?<!\w)(?:\+46|0046|0)\s?\(?0?\)?\s?7[02369](?:[\s-]?\d){7}\b"


def _unicode(pattern: str) -> str:
    """Java's \\w, \\d, \\b with Unicode meaning."""
    return "(?U)" + pattern


def tokens(text: Column) -> Column:
    """Search terms: lower case, other characters than a-z and 0-9 part words, stop words and words under three letters go, endings are cut."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*dict.fromkeys(STOP_WORDS)))

    def stem(w: Column) -> Column:
        out = None
        for s in SUFFIXES:
            cut = F.substring(w, F.lit(1), F.length(w) - len(s))
            hit = (F.length(w) > 4) & w.endswith(s)
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return out.otherwise(w)

    return F.coalesce(F.transform(kept, stem), F.array().cast("array<string>"))


def weighted_bag(title: Column, tags: Column, content: Column) -> Column:
    """Terms of a note: the title three times, the tags twice, the content once."""
    tag_text = F.coalesce(F.array_join(tags, " "), F.lit(""))
    t, g = tokens(title), tokens(tag_text)
    return F.concat(t, t, t, g, g, tokens(F.coalesce(content, F.lit(""))))


def slug(text: Column, longest: int | None = None) -> Column:
    """Lower-case runs of a-z and 0-9 joined by hyphens, trimmed before the cut."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s if longest is None else F.substring(s, 1, longest)


def estimate_tokens(text: Column) -> Column:
    """Four code points to a token."""
    return F.floor(F.length(text) / 4).cast("long")


def preview(text: Column, longest: int = 240) -> Column:
    return F.substring(text, 1, longest)


def clean_tags(tags: Column) -> Column:
    """Without #, lower case, the first six."""
    return F.slice(F.transform(tags, lambda t: F.lower(F.regexp_replace(F.trim(t), "^#+|#+$", ""))), 1, 6)


def value_spans(text: Column, strict: bool = False) -> Column:
    """Sorted distinct spans that state a value: scores, numbers with units, analytes with a number."""
    numeric, score = (STRICT_NUMERIC_CLAIM, STRICT_SCORE_NAME) if strict else (NUMERIC_CLAIM, SCORE_NAME)
    find = lambda p: F.regexp_extract_all(text, F.lit("(?i)(" + p + ")"), F.lit(1))
    analytes = F.transform(find(BARE_ANALYTE), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(find(numeric), find(score), analytes))), F.array().cast("array<string>"))


def validation_errors(title: Column, kind: Column, content: Column) -> Column:
    """Why a note is not valid; norms and protocols may state values, patterns and vocabulary may not."""
    bound = kind.isin("pattern", "vocabulary")
    hit = lambda p: F.coalesce(content.rlike("(?i)" + p), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(title), F.lit("")) == "", F.lit("empty title")),
            F.when(~F.coalesce(kind.isin("pattern", "norm", "vocabulary", "protocol"), F.lit(False)), F.lit("unknown kind")),
            F.when(bound & hit(SCORE_NAME), F.lit("score name")),
            F.when(bound & hit(NUMERIC_CLAIM), F.lit("numeric claim")),
            F.when(bound & hit(BARE_ANALYTE), F.lit("bare analyte")),
        )
    )


def scrub(text: Column, known: Column | None = None, strict: bool = False) -> Column:
    """Known values first, the longest before the shorter, then the patterns in order.

    ``known`` is array<struct<kind,value>>; values under three characters are left alone.
    """
    out = text
    if known is not None:
        fit = F.filter(known, lambda k: F.length(F.trim(k["value"])) >= 3)
        # longest first; equal lengths in order of value and kind
        order = F.array_sort(F.transform(fit, lambda k: F.struct((-F.length(k["value"])).alias("n"), F.trim(k["value"]).alias("value"), k["kind"].alias("kind"))))
        quote = lambda v: F.concat(F.lit("(?iu)"), F.regexp_replace(v, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
        safe = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
        out = F.aggregate(F.coalesce(order, F.array().cast("array<struct<n:int,value:string,kind:string>>")), out, lambda t, k: F.regexp_replace(t, quote(k["value"]), F.concat(F.lit("[REDACTED-"), safe(k["kind"]), F.lit("]"))))
    for kind, pattern in SCRUB_PATTERNS:
        if strict and kind == "phone":
            out = F.regexp_replace(out, _unicode(STRICT_PHONE), "[REDACTED-phone]")
        out = F.regexp_replace(out, _unicode(pattern), f"[REDACTED-{kind}]")
    return out


def unescape_copy(value: Column) -> Column:
    """A field of a dump: its null mark is empty; line feed, tab, return and backslash are unescaped in one pass, other escapes stay."""
    parts = F.regexp_extract_all(value, F.lit(r"(?s)(\\[ntr\\]|.)"), F.lit(1))
    one = F.transform(parts, lambda p: F.when(p == r"\n", "\n").when(p == r"\t", "\t").when(p == r"\r", "\r").when(p == r"\\", "\\").otherwise(p))
    return F.when(value == r"\N", F.lit("")).when(value.contains("\\"), F.array_join(one, "")).otherwise(value)


def volatility_days(volatility: Column) -> Column:
    """12mo, 90d, 2y in fixed days (a month 30, a year 365); anything else 365."""
    parts = r"(?i)^\s*(\d+)\s*(mo|m|d|y)\s*$"
    n, unit = F.regexp_extract(volatility, parts, 1), F.lower(F.regexp_extract(volatility, parts, 2))
    per = F.when(unit.isin("mo", "m"), 30).when(unit == "y", 365).otherwise(1)
    return F.when(F.coalesce(volatility.rlike(parts), F.lit(False)), n.try_cast("int") * per).otherwise(365).cast("int")
