"""Speech transcripts into clean speaker turns, by a finite-state line parser on Spark columns.

Each transcript is cut into lines; a line's form (caption number, caption times, legend, labelled
line, other) is its input to the parser, and the parser's state (the utterance that is open, its
speaker, the caption's time) is carried from line to line by windows over the transcript. The
text of an utterance is put together before annotations and hesitations are stripped, since
wrapped lines may cut them. Neighbours of one speaker are then merged. All patterns run in the JVM.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words that name a speaker's role, English and Swedish, abbreviations and misspellings.
ROLE_WORDS = {
    "doctor": "doctor docter doctr docotr doc dr md d physician physican clinician clinican gp doktor doktorn docktor läkare läkaren läkar läk",
    "patient": "patient pateint patinet paitent pat pt p patienten patinten",
    "nurse": "nurse nures nrse n rn ssk sköterska sköterskan skoterska sjuksköterska sjuksköterskan",
    "relative": "relative realtive rel wife husband son daughter mother father mum mom dad sister brother partner spouse aunt uncle niece nephew cousin grandmother "
    "grandfather grandson granddaughter anhörig anhörige anh fru hustru maka make man dotter mor mamma mormor farmor far pappa morfar farfar syster bror sambo moster faster morbror farbror kusin",
    "interpreter": "interpreter intepreter interpeter int tolk tolken",
}
ROLE_OF = {word: role for role, words in ROLE_WORDS.items() for word in words.split()}
#: Sounds that stand in round brackets or between asterisks, where spoken remarks stand too.
SOUNDS = (
    r"sniffs?|sniffing|inaudible|unintelligible|laughter|laughs?|laughing|chuckles?|coughs?|coughing|sighs?|sighing|sobs?|crying|groans?|yawns?|sneezes?|"
    r"long silence|silence|pause|long pause|beep|noise|background noise|crosstalk|music|phone rings|door closes|door opens|knocking|clears throat|"
    r"harklar sig|skrattar|skratt|hostar|hosta|suckar|suck|ohörbart|paus|lång paus|tystnad|lång tystnad|gråter|snyftar|brus|telefon ringer|dörren stängs"
)
#: Looking ahead for a separator takes time with the square of a line's length; longer lines do without.
LOOKED_THROUGH = 4000
_WORDS = "|".join(sorted(ROLE_OF, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]+(?:[ -]\p{Lu}[\p{L}'’-]+)?"
_TITLED = rf"(?:(?i:dr|doctor|doktor|mr|mrs)\.? {_NAME})"
_CODE = r"(?i:speaker[ _-]?\d+|spk[ _-]?\d+|s\d+)"
_LABEL = rf"(?:{_TITLED}|{_CODE}|(?iu:{_WORDS})\.?)"
#: Inside a line a single letter counts as a label only in upper case.
_INNER = rf"(?:{_TITLED}|{_CODE}|[PDN]\.?|(?iu:{'|'.join(w for w in _WORDS.split('|') if len(w) > 1)})\.?)"
_CLOCK = r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?"
_TIME = rf"(?:\[{_CLOCK}\]|\({_CLOCK}\)|<{_CLOCK}>|\[\d+(?:\.\d+)? ?s\]|\d{{1,2}}:\d\d:\d\d(?:[.,]\d{{1,3}})?|{_CLOCK}\s*\|)"
_SEPARATOR = r"(?:\s*[:：]|\s*>)(?=\s|\*|$)"


def _head(label: str) -> str:
    return rf"(?:{_TIME}\s*)?\*{{0,2}}{label}\*{{0,2}}\s*(?:{_TIME}\s*)?{_SEPARATOR}\*{{0,2}}"


#: Groups: 1 time before the label, 2 label, 3 time after it, 4 the text.
_UTTERANCE = rf"(?s)^\s*({_TIME})?\s*\*{{0,2}}({_LABEL})\*{{0,2}}\s*({_TIME})?{_SEPARATOR}\*{{0,2}}(.*)$"
_ARROW = rf"^\s*({_CLOCK})\s*-->\s*{_CLOCK}.*$"
_LEGEND = rf"^\s*(?:\[(?i:legend)\]|#?\s*(?i:speakers|legend|key)\s*:|{_CODE}\s*(?:=|(?i:is|är)\s)).*{_CODE}?.*$"
_EXPLAINED = rf"({_CODE})\s*(?:=|(?i:\bis\b|\bär\b))\s*({_LABEL})"
#: Times of the recording inside the text: in brackets, with fractions of a second, or before a bar.
_TIMES = rf"\[{_CLOCK}\]|\({_CLOCK}\)|<{_CLOCK}>|\[\d+(?:\.\d+)? ?s\]|(?<![\d:])\d{{1,2}}:\d\d:\d\d[.,]\d{{1,3}}(?!\d)|(?<![\d:]){_CLOCK}\s*\|"
#: Square, curly and angle brackets and double round ones hold no speech, but for a written-out @ or dot.
_ANNOTATION = (
    rf"\(\([^()]{{1,60}}\)\)|\[(?!(?i:at|dot|punkt|snabel-?a)\])[^\[\]]{{1,60}}\]|\{{[^{{}}]{{1,60}}\}}|<[\p{{L}}][^<>@]{{0,60}}>"
    rf"|\((?iu:{SOUNDS})\)|\*(?iu:{SOUNDS})\*"
)
_END = r"(?:\.\.\.|…|[,.!?;-])*"
#: Hesitation sounds as whole pieces; ``er`` and ``mm`` only with a comma or dots, since they are words.
_HESITATION = (
    rf"(?<!\S)(?:(?iu:u+h+m*|u+m+|e+rm+|e+h+m*|h+m+|m{{3,}}|ö+h+m*|ö+m+|a+h+m+|ä+h+m*|eem+){_END}"
    rf"|(?:[Ee]r+)(?:\.\.\.|…|,)+|(?:[Mm]m)(?:\.\.\.|…)|(?<!\b(?:of|by) \d{{1,9}} )[Mm]m,|(?<=\b(?:of|by) \d{{1,9}} )[Mm]m,(?=\s+mm\b))(?!\S)"
)


def _milliseconds(clock: Column) -> Column:
    """A time of the recording in milliseconds; brackets, bar and letter s are ignored."""
    t = F.regexp_replace(F.regexp_replace(clock, r"[^\d:.,]", ""), ",", ".")
    parts = F.split(t, ":")
    return F.round(F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + F.coalesce(p.try_cast("double"), F.lit(0.0))) * 1000).cast("long")


def _role(label: Column) -> Column:
    """doctor, patient, ... of a label; null for a code."""
    plain = F.trim(F.regexp_replace(F.lower(label), r"\.", ""))
    words = F.create_map(*[F.lit(x) for x in chain.from_iterable(ROLE_OF.items())])
    titled = F.when(plain.rlike(r"^(?:dr|doctor|doktor) "), F.lit("doctor")).when(plain.rlike(r"^(?:mr|mrs) "), F.lit("patient"))
    return F.coalesce(F.element_at(words, plain), titled)


def strip_speech(text: Column) -> Column:
    """Spoken text without times of the recording, annotations and hesitation sounds, blanks evened."""
    out = F.regexp_replace(text, _TIMES, " ")
    out = F.regexp_replace(out, _ANNOTATION, " ")
    out = F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))
    out = F.regexp_replace(out, _HESITATION, "")
    return F.trim(F.regexp_replace(out, r" {2,}", " "))


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w.rlike(r"[\p{L}\p{Nd}]"))).cast("int")


def speaker_turns(transcripts: DataFrame, key: str = "id", text: str = "transcription") -> DataFrame:
    """(key, turn_no, speaker, n_words, text): clean turns of each transcript in spoken order.

    Defined cases: null, empty and blank transcripts and those of annotations alone have no turn;
    rows with equal key and text count once, different texts of one key are numbered on their own;
    a null key is a key; a code that no legend explains and text before any label have the speaker
    ``unknown``; equal times keep the written order; other columns are not read; an empty table gives
    an empty result. One transcript's lines are handled together in one task, transcripts apart.
    """
    rows = transcripts.select(F.col(key).alias("key"), F.col(text).alias("raw")).filter(F.col("raw").rlike(r"\S"))
    rows = rows.groupBy("key", F.sha2("raw", 256).alias("mark")).agg(F.first("raw").alias("raw"))
    real_breaks = F.col("raw").contains("\n")
    even = F.when(real_breaks, F.col("raw")).otherwise(F.regexp_replace(F.regexp_replace("raw", r"\\r\\n|\\n|\\r", "\n"), r"\\t", "\t"))
    even = F.regexp_replace(even, r"\r\n?", "\n")
    codes = F.regexp_extract_all("even", F.lit(_EXPLAINED), F.lit(1))
    named = F.regexp_extract_all("even", F.lit(_EXPLAINED), F.lit(2))
    rows = rows.withColumn("even", even).select("key", "mark", "even", F.transform(codes, lambda c: F.lower(c)).alias("codes"), named.alias("named"))
    lines = rows.select("key", "mark", "codes", "named", F.posexplode(F.split("even", "\n")).alias("line", "s"))
    lines = lines.filter(F.col("s").rlike(r"\S") & ~F.col("s").rlike(r"^\s*\d+\s*$") & ~F.col("s").rlike(r"^\s*WEBVTT\b"))
    legend = F.col("s").rlike(_LEGEND) & (F.size(F.regexp_extract_all("s", F.lit(_EXPLAINED), F.lit(1))) > 0)
    lines = lines.filter(~legend)
    # labels inside a line begin a new piece of it
    # in lines of usual length none of the many labels is tried where no separator follows; both ways find the same
    heads = lambda look: F.regexp_replace("s", rf"(^\s*{_head(_LABEL)})|\s+{look}({_head(_INNER)})", "\u0001$1$2")
    pieces = F.split(F.when(F.length("s") <= LOOKED_THROUGH, heads("(?=[^:：>]*[:：>])")).otherwise(heads("")), "\u0001")
    lines = lines.select("key", "mark", "codes", "named", "line", F.posexplode(pieces).alias("piece", "s")).filter(F.col("s").rlike(r"\S"))
    # the parts of a labelled line in one pass of its pattern: time, label, time, text
    parts = F.split(F.regexp_replace("s", _UTTERANCE, "\u0001$1\u0001$2\u0001$3\u0001$4"), "\u0001", 5)
    lines = lines.withColumn("parts", parts).withColumn("arrow", F.nullif(F.regexp_extract("s", _ARROW, 1), F.lit("")))
    labelled, part = F.size("parts") == 5, lambda n: F.nullif(F.get("parts", F.lit(n)), F.lit(""))
    lines = lines.withColumn("label", F.when(labelled, part(2))).withColumn("clock", F.when(labelled, F.coalesce(part(1), part(3))))
    lines = lines.withColumn("said", F.when(F.col("label").isNotNull(), F.get("parts", F.lit(4))).otherwise(F.col("s"))).drop("parts")
    so_far = Window.partitionBy("key", "mark").orderBy("line", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # state: captions begun, utterances begun
    lines = lines.withColumn("cue", F.count("arrow").over(so_far)).withColumn("cue_clock", F.last("arrow", ignorenulls=True).over(so_far))
    spoken = lines.filter("arrow IS NULL")
    before = Window.partitionBy("key", "mark").orderBy("line", "piece")
    begins = F.col("label").isNotNull() | (F.col("cue") != F.lag("cue", 1, -1).over(before))
    spoken = spoken.withColumn("begins", begins.cast("int")).withColumn("n", F.sum("begins").over(so_far)).withColumn("speaker_label", F.last("label", ignorenulls=True).over(so_far))
    own_code = F.element_at("named", F.nullif(F.array_position("codes", F.lower("speaker_label")), F.lit(0)).cast("int"))
    spoken = spoken.withColumn("role", F.coalesce(_role(F.col("speaker_label")), _role(own_code), F.lit("unknown")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece", "said"))), lambda x: x["said"]), " ")
    utterances = spoken.groupBy("key", "mark", "n").agg(
        F.first("role").alias("speaker"), F.max(F.when(F.col("begins") == 1, F.coalesce("clock", "cue_clock"))).alias("clock"), joined.alias("said")
    )
    timed = Window.partitionBy("key", "mark")
    utterances = utterances.withColumn("all_timed", F.count("clock").over(timed) == F.count("*").over(timed))
    at = F.when(F.col("all_timed"), _milliseconds(F.col("clock"))).otherwise(F.lit(0))
    clean = utterances.select("key", "mark", "n", "speaker", at.alias("at"), strip_speech(F.col("said")).alias("text"))
    clean = clean.withColumn("n_words", _n_words(F.col("text"))).filter("n_words > 0")
    order = Window.partitionBy("key", "mark").orderBy("at", "n")
    changed = F.coalesce((F.col("speaker") != F.lag("speaker").over(order)), F.lit(True)).cast("int")
    clean = clean.withColumn("changed", changed).withColumn("turn_no", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text_out = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "text"))), lambda x: x["text"]), " ")
    turns = clean.groupBy("key", "mark", "turn_no").agg(F.first("speaker").alias("speaker"), F.sum("n_words").cast("int").alias("n_words"), text_out.alias("text"))
    return turns.select(F.col("key").alias(key), F.col("turn_no").cast("int").alias("turn_no"), "speaker", "n_words", "text")
