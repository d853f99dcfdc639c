"""Text expressions, Column in and Column out; every one stays in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"  # the 32 ASCII marks
STOP = r"[.!?。！？]"


def normalize_ws(c: Column) -> Column:
    """Stripped, every run of Unicode white space one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_match(c: Column) -> Column:
    """Lower case, ASCII punctuation as spaces, white space normalised."""
    return normalize_ws(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, " "))


def sentences(c: Column) -> Column:
    return F.filter(F.split(normalize_ws(c), rf"(?<={STOP})\s+"), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Blank-line separated blocks, lines stripped and joined by a space, blank ones dropped."""
    blocks = F.split(F.coalesce(c, F.lit("")), r"\n[ \t]*\n")
    return F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s*\n\s*", " "))), lambda b: b != "")


def tokens_mining(c: Column) -> Column:
    """ASCII letter runs of three or more, then lower-cased, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]{3,}"), 0), F.lower)


def tokens_alnum(c: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def token_set(c: Column) -> Column:
    """The set of tokens_alnum over the match-normalised text."""
    return F.array_distinct(tokens_alnum(normalize_match(c)))


def word_set(c: Column) -> Column:
    """The set of white-space separated words of the match-normalised text."""
    return F.array_distinct(F.filter(F.split(normalize_match(c), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"[0-9]+", 0).try_cast("double")


def quick_equiv(a: Column, b: Column) -> Column:
    """Equal after normalisation, or one contains the other (the shorter of two words or eight characters at least),
    or the first numbers agree. Normalised text has no sign and no decimal point, so 3.14 equals 3.99."""
    x, y = normalize_match(a), normalize_match(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    enough = (F.size(F.split(short, " ")) >= 2) | (F.length(short) >= 8)
    numbers = F.coalesce(F.abs(first_number(x) - first_number(y)) < 1e-9, F.lit(False))
    return (x != "") & (y != "") & ((x == y) | (enough & F.contains(long, short)) | numbers)


def verdict(c: Column) -> Column:
    """The verdict a judge's answer names, by substring, entailment first."""
    n = normalize_match(c)
    return (
        F.when(F.contains(n, F.lit("entailed")), "ENTAILED")
        .when(F.contains(n, F.lit("contradicted")), "CONTRADICTED")
        .when(F.contains(n, F.lit("not enough info")) | F.contains(n, F.lit("insufficient")), "NOT_ENOUGH_INFO")
        .when(n != "", F.upper(F.split(n, " ")[0]))
        .otherwise("UNKNOWN")
    )


def tristate(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "yes", "y", "1"), True).when(s.isin("false", "no", "n", "0"), False)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
