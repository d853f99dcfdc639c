"""The most similar sets of each set, exactly: rare words first, then only what can still beat the kth result.

Words are ordered by ascending frequency in their group. If two sets have a Jaccard similarity of t or more, then
- neither is smaller than t times the other (length filter),
- the first n - ceil(t n) + 1 words of each, in that order, hold a common word (prefix filter), and
- from their first common word on, enough words are left in both (position filter).

A first round compares each set that asks with those that share one of its rarest words and with a handful of its
group, which gives it a kth result so far. That is its bound t for the second round, in which its frequent words, the last
in order, take no part, nor do rows that the filters rule out. Candidates are then compared by their whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.joins import HOT, running_sum, spread_join, stable

SEEDS, RARE = 8, 32  # words of a set that the first round joins on, and rows that such a word has at most
HANDFUL = 48  # other sets, about, that each set meets in the first round whatever its words
_SLACK = 1e-9


def _prefix(n: Column, t: Column) -> Column:
    """How many first words of n hold a common one with any set of similarity t or more."""
    return n - F.ceil(t * n - _SLACK) + 1


def ordered_sets(rows: DataFrame) -> DataFrame:
    """(g, id, asked, n, words): each set's words with their number of rows in the group, rarest first."""
    t = rows.select("g", "id", "asked", F.explode(F.array_distinct(F.filter("s", lambda w: w.isNotNull()))).alias("word"))
    t = stable(t)
    df = t.groupBy("g", "word").agg(F.count("*").alias("df")).withColumn("rows", F.col("df"))
    met = spread_join(t, df, ["g", "word"], t.count(), "rows", by="id")
    return met.groupBy("g", "id", "asked").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("words")).withColumn("n", F.size("words"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (g, id, peer) with the jaccard of their whole sets."""
    words = F.transform("words", lambda w: w["word"])
    one = sets.select("g", "id", words.alias("s"))
    other = sets.select("g", F.col("id").alias("peer"), words.alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(one, ["g", "id"]).join(other, ["g", "peer"]).select("g", "id", "peer", (both / (F.size("s") + F.size("t") - both)).alias("jaccard")).where("jaccard > 0")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("g", "id").orderBy(F.desc(F.round("jaccard", 9)), "peer")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (g, id, peer) that share one of the SEEDS rarest words of the asking set, among words of RARE rows at most,
    and those of one handful, into which hashes of ids deal each group."""
    word = sets.select("g", "id", "asked", F.posexplode("words").alias("i", "w")).where(F.col("w.df").between(2, RARE))
    ask = word.where(F.col("asked") & (F.col("i") < SEEDS)).select("g", F.col("w.word").alias("word"), "id")
    other = word.select("g", F.col("w.word").alias("word"), F.col("id").alias("peer"))
    by_word = ask.join(other, ["g", "word"])
    hands = sets.groupBy("g").agg(F.ceil(F.count("*") / F.lit(HANDFUL)).alias("hands"), F.count("*").alias("rows"))
    dealt = spread_join(sets.select("g", "id", "asked"), hands, ["g"], sets.count(), "rows", by="id").withColumn("hand", F.pmod(F.xxhash64("id"), F.col("hands")))
    by_hand = dealt.where("asked").select("g", "hand", "id").join(dealt.select("g", "hand", F.col("id").alias("peer")), ["g", "hand"])
    return by_word.select("g", "id", "peer").union(by_hand.select("g", "id", "peer")).where("id <> peer").distinct()


def second_pairs(sets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs (g, id, peer) by the words that the first round left out, under each asking set's bound (g, id, t).

    A word's rows are dealt into blocks of about HOT; each asking row meets every block of its word, in a task of its own."""
    word = stable(sets.join(bounds, ["g", "id"], "left").select("g", "id", "asked", "n", F.coalesce("t", F.lit(0.0)).alias("t"), F.posexplode("words").alias("i", "w")).where("w.df > 1").select("g", "id", "asked", "n", "t", "i", F.col("w.word").alias("word"), F.col("w.df").alias("df")))
    left_out = ~((F.col("df") <= RARE) & (F.col("i") < SEEDS))
    ask = stable(word.where(F.col("asked") & left_out & (F.col("i") < _prefix(F.col("n"), F.col("t")))))
    wanted = ask.groupBy("g", "word").agg(F.min("t").alias("least"), F.min("df").alias("df")).withColumns({"blocks": F.ceil(F.col("df") / F.lit(HOT)), "rows": F.col("df")})
    wanted = stable(wanted)
    total = word.count()
    index = spread_join(word.drop("df"), wanted.drop("df"), ["g", "word"], total, "rows", by="id").where(F.col("i") < _prefix(F.col("n"), F.col("least")))
    index = index.select("g", "word", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.col("id").alias("peer"), F.col("n").alias("m"), F.col("i").alias("j"))
    dealt = spread_join(ask.drop("df"), wanted.select("g", "word", "blocks", "rows"), ["g", "word"], total, "rows", by="id")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    n, m, t = F.col("n"), F.col("m"), F.col("t")
    rest = F.least(n - F.col("i"), m - F.col("j"))  # common words at most, if this is the first one
    can = (m >= t * n - _SLACK) & (n >= t * m - _SLACK) & (F.col("j") < _prefix(m, t)) & (rest >= t / (1 + t) * (n + m) - _SLACK)
    return dealt.join(index, ["g", "word", "block"]).where((F.col("id") != F.col("peer")) & can).select("g", "id", "peer").distinct()


def similar_topk(rows: DataFrame, k: int = 10, formed: list | None = None) -> DataFrame:
    """(g, id, peer, jaccard, rank): the k most similar other sets of its group, for each set that asks.

    rows are (g, id, asked, s: an array of words); ties go to the smaller id, and sets without a common word are no result.
    An id is unique in its group. A null or empty set has no peers and is none; a null group is a group of its own;
    a null `asked` does not ask. `formed` receives the pairs that were compared, for those who count them."""
    kind = rows.schema["g"].dataType.simpleString()
    keyed = rows.select(F.to_json(F.struct(F.col("g").alias("g"))).alias("g"), "id", F.coalesce("asked", F.lit(False)).alias("asked"), "s")
    sets = stable(ordered_sets(keyed))
    one = stable(first_pairs(sets))
    seen = stable(_top(_compared(one, sets), k))
    bounds = seen.where(F.col("rank") == k).select("g", "id", F.col("jaccard").alias("t"))
    two = stable(second_pairs(sets, bounds).join(one, ["g", "id", "peer"], "left_anti"))
    if formed is not None:
        formed += [one, two]
    out = _top(seen.drop("rank").union(_compared(two, sets)), k)
    return out.select(F.from_json("g", f"struct<g:{kind}>").getField("g").alias("g"), "id", "peer", "jaccard", "rank")


def places(rows: DataFrame) -> DataFrame:
    """rows (g, id) with `place`, a row's number in its group by ascending id from 1, and `size`, the group's; no task holds a group."""
    run = running_sum(rows.select("g", "id"), ["g", "id"], F.lit(1), "upto")
    groups = run.groupBy("g").agg((F.min("upto") - 1).alias("base"), F.count("*").alias("size")).withColumn("rows", F.col("size"))
    met = spread_join(run, groups, ["g"], run.count(), "rows", by="id")
    return met.select("g", "id", (F.col("upto") - F.col("base")).alias("place"), "size")
