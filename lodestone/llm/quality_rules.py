"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: navigation (bars, arrows, bullets between a few words), boilerplate
(licence, cookie and copyright lines), punctuation (symbol noise, or a long line that never ends a
sentence nor has a comma). Failing lines are removed, and a
document that loses too much of its word characters is rejected. Base rules on the whole text come
first: too few words, or too many words in 3-word windows that recur.

Repeated windows without an explode: every window's hash shares a 64-bit integer with its place (34 and
30 bits), the integers are sorted as a primitive array, and neighbours with one hash are candidates;
these few are sorted again under a second hash. So n_repeat_words rests on 68 bits of hash, not on the words:
two different windows of a document of a million words agree in them once in some hundred million documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import WORD

MIN_WORDS = 50
MAX_REPEAT = 50  # hundredths of words in recurring 3-word windows
MAX_LOSS = 50  # hundredths of word characters that removed lines may hold
MIN_SYMBOLS = 3  # symbols that a line must have to be noise: one price, share or heading mark is none
MAX_SYMBOLS = 4  # hundredths of a line's word characters that may be symbols
SHORT_LINE = 40  # words up to which a line with a boilerplate phrase is boilerplate
LONG_LINE = 15  # words from which a line must have sentence punctuation

# fixed values: characters that the base rule counts as symbols
SYMBOLS = "#*$%&|<>"
# fixed values: separators of navigation lines
BARS = "|»›→•·"
# fixed values: phrases of boilerplate lines, in lower case
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "is licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "powered by",
    "copyright ©",
    "skip to content",
)

# fixed values: marks that end or part sentences, in the scripts that have their own
MARKS = ".!?,;:…。！？，；：、।॥۔؟؛،։።፣"

_PLACE = (1 << 30) - 1


def _without(text: Column, chars: str) -> Column:
    """Text less some characters: a byte search each, far cheaper here than a pattern."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _dense(text: Column) -> Column:
    return _without(text, " \n\t\r\x0b\x0c")


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _recurring(coded: Column) -> Column:
    """Of ascending (hash << 30 | place) integers, those whose hash a neighbour has."""
    same = lambda x, y: F.shiftright(x, 30) == F.shiftright(y, 30)
    return F.filter(coded, lambda x, i: F.coalesce(same(x, F.get(coded, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(coded, i + 1)), F.lit(False)))


def _code(hash_: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(hash_, 30), 30).bitwiseOR(place.cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct `__base` of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    step = docs.withColumn("__words", words).withColumn("__lines", lines)
    # every 3-word window, in order: its hash under the high 34 bits, its place under the low 30
    step = step.withColumn(
        "__coded",
        F.sort_array(
            F.transform(
                F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0))),
                lambda w, i: _code(F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)), i),
            )
        ),
    )
    step = step.withColumn("__places", F.transform(_recurring(F.col("__coded")), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")))
    # the candidates again, under another hash of the same words
    step = step.withColumn(
        "__again",
        F.sort_array(F.transform("__places", lambda i: _code(F.xxhash64(F.lit("again"), F.get("__words", i + 2), F.get("__words", i + 1), F.get("__words", i)), i))),
    )
    step = step.withColumn("__places", F.sort_array(F.transform(_recurring(F.col("__again")), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))))
    covered = F.aggregate(F.transform("__places", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__places", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    base = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(_dense(text)).cast("long").alias("word_chars"),
        _removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return step.withColumn("__base", base).drop("__words", "__coded", "__places", "__again", "__lines")


def clean_lines(lines: Column) -> Column:
    """Those of an array of lines that pass the navigation, boilerplate and punctuation rules.

    A line without a word never fails. What several rules look at is worked out once a line."""
    facts = F.transform(
        lines,
        lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"), _removed(x, BARS).alias("bars"), _removed(x, SYMBOLS).alias("symbols"), F.length(_dense(x)).alias("chars"), F.lower(x).alias("low"))
    )

    def fails(f: Column) -> Column:
        boilerplate = F.lit(False)
        for phrase in BOILERPLATE:
            boilerplate = boilerplate | f["low"].contains(phrase)
        navigation = f["bars"] * 4 >= f["n"]
        noise = (f["symbols"] >= MIN_SYMBOLS) & (f["symbols"] * 100 > f["chars"] * MAX_SYMBOLS)
        endless = (f["n"] >= LONG_LINE) & ~f["low"].rlike(f"[{MARKS}]")
        return (f["n"] > 0) & (navigation | noise | endless | ((f["n"] <= SHORT_LINE) & boilerplate))

    return F.transform(F.filter(facts, lambda f: ~fails(f)), lambda f: f["line"])


def judged(docs: DataFrame) -> DataFrame:
    """docs with a struct `__found`: base, base_failed, lost_chars (word characters in removed lines), kept, clean.

    A null or empty text has no words and fails the base rule; a very long one is judged whole. Repeated rows, ids or
    nulls in other columns change nothing; an empty table gives no rows. All columns of docs stay, extra ones too,
    but for names that start with `__`. `clean` is the text without failed
    lines. Lines that repeat an earlier line count as lost only if a navigation, boilerplate or
    punctuation rule fails them; repetition has its own base rule."""
    step = measured(docs).withColumn("__parts", F.split(F.coalesce("text", F.lit("")), "\n"))
    step = step.withColumn("__clean", F.array_join(clean_lines(F.col("__parts")), "\n"))
    step = step.withColumn("__lost", (F.col("__base")["word_chars"] - F.length(_dense(F.col("__clean")))).cast("long"))
    base = F.col("__base")
    failed = (base["n_words"] < MIN_WORDS) | (base["n_repeat_words"] * 100 > base["n_words"] * MAX_REPEAT)
    kept = ~failed & (F.col("__lost") * 100 <= base["word_chars"] * MAX_LOSS)
    found = F.struct(base.alias("base"), failed.alias("base_failed"), F.col("__lost").alias("lost_chars"), kept.alias("kept"), F.col("__clean").alias("clean"))
    # through a generator, because a filter on a result would otherwise be pushed below the projections, which
    # puts whole expressions into lambdas and works them out again for every word
    return step.select(*[F.col(c) for c in docs.columns], F.explode_outer(F.array(found)).alias("__found"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base figures, base_failed, lost_chars and kept, for every document."""
    docs = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "__found.base.*", "__found.base_failed", "__found.lost_chars", "__found.kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept documents without their failed lines: text is the clean text, n_chars its length.

    Nulls, empty and long texts, repeated rows, an empty table and extra columns as for `judged`: null and empty
    texts go."""
    clean = judged(docs).where("__found.kept").withColumn("text", F.col("__found.clean"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(c) for c in docs.columns])


def _sql_line_fails(line: str) -> str:
    words, chars = f"len(regexp_extract_all({line}, '[^\\x20\\x09-\\x0D]+'))", f"length(regexp_replace({line}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
    phrases = " OR ".join(f"contains(lower({line}), '{p}')" for p in BOILERPLATE)
    return (
        f"({words} > 0 AND (len(regexp_extract_all({line}, '[{BARS}]')) * 4 >= {words} OR (({phrases}) AND {words} <= {SHORT_LINE})"
        f" OR (len(regexp_extract_all({line}, '[{SYMBOLS}]')) >= {MIN_SYMBOLS} AND len(regexp_extract_all({line}, '[{SYMBOLS}]')) * 100 > {chars} * {MAX_SYMBOLS})"
        f" OR ({words} >= {LONG_LINE} AND NOT regexp_matches({line}, '[{MARKS}]'))))"
    )


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS parts FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS seq FROM w, range(1, greatest(1, len(words) - 1)) r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 3) o(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
        (len(list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(array_to_string(list_filter(parts, lambda x: {_sql_line_fails('x')}), ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS lost_chars
      FROM w LEFT JOIN cov USING (doc_id)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOSS} AS kept FROM g
"""
