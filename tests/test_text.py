import re

from pyspark.sql import functions as F

from notewright.functions import text as X


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_tokens(spark):
    def plain(t):
        out = []
        for w in re.sub(r"[^a-z0-9\s]", " ", t.lower()).split():
            if w in X.STOP_WORDS or len(w) < 3:
                continue
            s = next((s for s in X.SUFFIXES if len(w) > 4 and w.endswith(s)), "")
            out.append(w[: len(w) - len(s)])
        return out

    texts = ["Bodies using gas, the studies", "Läkaren skriver ner", "", "  a to ", "ECG-trace\u000b12 leads!"]
    assert values(spark, X.tokens(F.col("x")), [(t,) for t in texts]) == [plain(t) for t in texts]
    assert values(spark, X.tokens(F.col("x")), [(None,)]) == [[]]


def test_slug_and_budget(spark):
    assert values(spark, X.slug(F.col("x"), 10), [(" Åska & Regn över -- byn ",), ("",)]) == ["ska-regn-v", ""]
    assert values(spark, X.estimate_tokens(F.col("x")), [("abcdefg",), ("😀" * 8,)]) == [1, 2]


def test_value_spans(spark):
    text = ["LDL at last 4.5 and 40 mg daily, HAS-BLED 3", "40% of cases, 40%of", "optimism", None]
    assert values(spark, X.value_spans(F.col("x")), [(t,) for t in text]) == [["40 mg", "HAS-BLED", "LDL at last 4.5"], ["40%"], ["timi"], []]
    assert values(spark, X.value_spans(F.col("x"), strict=True), [("optimism",), ("40% so",)]) == [[], ["40%"]]


def test_validation(spark):
    rows = [("t", "pattern", "rest"), (" ", "x", None), ("t", "norm", "GRACE 40 mg"), ("t", "vocabulary", "GRACE 40 mg")]
    got = values(spark, X.validation_errors(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string")
    assert got == [[], ["empty title", "unknown kind"], [], ["score name", "numeric claim"]]


def test_scrub_against_python(spark):
    texts = ["Ring 070-123 45 67 or mail a.b@c.se, född 1950-01-02, MRN: 77x, Storgatan 5, 123 45", "19500102-1234 is Ann, ANN and $1\\", "nothing", None]
    known = [("name", "Ann"), ("odd", "$1\\"), ("x", "a")]

    def plain(t):
        if t is None:
            return None
        for kind, v in sorted(known, key=lambda k: -len(k[1])):
            if len(v.strip()) >= 3:
                t = re.sub(re.escape(v), lambda m, k=kind: f"[REDACTED-{k}]", t, flags=re.I)
        for kind, p in X.SCRUB_PATTERNS:
            t = re.sub(p, f"[REDACTED-{kind}]", t)
        return t

    known_column = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in known])
    assert values(spark, X.scrub(F.col("x"), known_column), [(t,) for t in texts]) == [plain(t) for t in texts]
    assert values(spark, X.scrub(F.col("x"), strict=True), [("tel +46701234567 nu",)]) == ["tel [REDACTED-phone] nu"]


def test_unescape_and_volatility(spark):
    assert values(spark, X.unescape_copy(F.col("x")), [(r"a\nb\\n\tc\q",), (r"\N",), ("",)]) == ["a\nb\\n\tc\\q", "", ""]
    assert values(spark, X.volatility_days(F.col("x")), [("12mo",), ("90D",), (" 2 y ",), ("soon",), (None,)]) == [360, 90, 730, 365, 365]


def test_clean_tags(spark):
    assert values(spark, X.clean_tags(F.col("x")), [(["#A", "b ", None, "c", "d", "e", "f"],)], "x array<string>") == [["a", "b", None, "c", "d", "e"]]
