"""Mixing sources to target weights by subset-sum budget fitting.

Targets share the corpus's words by source weight; a source's target stops at 3 times its size and the
excess goes to the others by weight (solved on one number a source, never on documents). A source whose
target is at least its size takes whole rounds of all its documents first. What is left of the target is
a budget for one more copy of some documents, which is fitted on counts alone: documents are counted by exact
length; a proportional share of every length is taken, long lengths fill most of the rest, and a
bounded-knapsack dynamic programme over the remaining budget finds the fill that comes nearest. The
counts then become documents: of each length, those that come first under a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.shared import cut, fan_out, ranked, spread_join, word_count

WEIGHTS = (5, 2, 1)
MOST = 3  # times a document, and a source, may be taken
BUDGET = 1 << 15  # words that the dynamic programme fills
GROUP = 512  # documents of one source and length that one window ranks, about


def fill(lengths: list[int], counts: list[int], budget: int, dp_budget: int = BUDGET) -> list[int]:
    """How many of each length to take so that their sum comes nearest to budget without passing it
    (up to the reach of the last programme), never more than its count."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]  # the same share of every length
    left = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:  # longest first, down to what the programme can fill
        k = min(counts[i] - take[i], max(0, left - dp_budget // 2) // lengths[i])
        take[i] += k
        left -= k * lengths[i]
    for i in reversed(order):  # short documents give back, so that the programme has room to choose
        k = min(take[i], max(0, dp_budget - left) // (4 * lengths[i]))
        take[i] -= k
        left += k * lengths[i]
    left_max = min(left, 4 * dp_budget)
    mask, reach, steps = (1 << (left_max + 1)) - 1, 1, []
    for i in order:  # bounded counts as powers of two
        if lengths[i] > left_max:
            continue
        free, p = min(counts[i] - take[i], left_max // lengths[i]), 1
        while free > 0:
            k = min(p, free)
            steps.append((i, k, reach))
            reach |= (reach << (k * lengths[i])) & mask
            free, p = free - k, p * 2
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the water level is found on sums alone.

    In the order of size over weight, the sources that stop at MOST times their size come first. Were the first k
    of them to stop, the others' level would be what is left over their weights: it rises with k until no more
    must stop, and falls from there on. So the level is the highest of these, from two prefix sums."""
    turn = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
    rows = cut(ranked(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], "__rank").select("source", "source_size", turn.alias("weight")), "sources")
    total, weights = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    full = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    stopped = ranked(ranked(rows, full, "__sizes", "source_size"), full, "__weights", "weight")
    level = stopped.agg(F.max((F.lit(total) - MOST * F.col("__sizes")) / (F.lit(weights) - F.col("__weights")))).first()[0] or 0.0
    return rows.select("source", "source_size", F.least(F.col("source_size") * float(MOST), F.col("weight") * F.lit(float(level))).alias("target"))


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths and counts -> whole rounds, and how many of each length once more."""
    pdf = pdf.sort_values("size").reset_index(drop=True)
    size, target = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
    rounds = min(MOST, target // size) if size else 0
    pdf["rounds"], pdf["more"] = rounds, 0
    some = pdf.index[pdf["size"] > 0]
    if rounds < MOST and len(some):
        pdf.loc[some, "more"] = fill(pdf.loc[some, "size"].tolist(), pdf.loc[some, "n"].tolist(), target - rounds * size)
    return pdf[["source", "size", "n", "rows", "source_size", "target", "rounds", "more"]]


def decided(docs: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, key, size, source_size, target, taken): one narrow row a row of docs.

    A null text has size 0; a document of size 0 is taken 0 words. A null source is a source, the last; a null
    doc_id is an id. A very long text is one document of its size. Rows that repeat a whole document are one row
    with a count while the mix is fitted, and each is taken by itself. If all sizes are 0, all targets are 0. An
    empty table gives no rows. Other columns of docs, whatever their names, are not read."""
    every = cut(_narrow(docs, seed).withColumn("size", word_count(F.col("text"))).drop("text"), "sizes")
    rows = cut(every.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("c")), "documents")
    counts = cut(rows.groupBy("source", "size").agg(F.sum("c").alias("n"), F.count("*").alias("rows")), "lengths")
    sources = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")

    named = counts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = named.groupBy("source").applyInPandas(_plan, "source string, size long, n long, rows long, source_size long, target double, rounds long, more long")
    plan = cut(plan.select(_code("source").alias("code"), "size", "rows", "source_size", "target", "rounds", "more", F.ceil(F.col("n") / F.lit(GROUP)).alias("salts")), "plan")
    total = rows.count()
    coded = rows.select("doc_id", "key", _code("source").alias("code"), "size", "c")
    tagged = spread_join(coded, plan, ["code", "size"], total, "rows", by="key").withColumn("salt", F.pmod(F.shiftright("key", 8), F.col("salts"))).drop("salts")

    # `more` of each length in the order of (salt, hash): counts say which salts are taken whole, and in the
    # one salt that is taken in part, of about GROUP documents, the hash of the last one taken is found, and how many of it
    part = tagged.where("more > 0").groupBy("code", "size", "salt", "more").agg(F.sum("c").alias("m"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("code", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = cut(part.select("code", "size", "salt", "m", "rows", (F.col("more") - before).alias("quota")).where("quota > 0"), "quota")
    place = ["code", "size", "salt"]
    inner = spread_join(tagged.select(*place, "key", "c"), quota.where("quota < m").drop("m"), place, total, "rows", by="key")
    ahead = F.coalesce(F.sum("c").over(Window.partitionBy(*place).orderBy("key", "c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = inner.withColumn("left", F.col("quota") - ahead).where("left > 0").groupBy(*place).agg(F.max(F.struct("key", "left")).alias("last"))
    whole = quota.where("quota >= m").select(*place, F.struct(F.lit((1 << 63) - 1).alias("key"), F.lit(0).cast("long").alias("left")).alias("last"))
    limits = cut(edge.union(whole).join(quota.select(*place, "rows"), place), "limits")
    chosen = spread_join(tagged.where("more > 0"), limits, place, total, "rows", by="key")
    again = F.when(F.col("key") < F.col("last.key"), F.col("c")).when(F.col("key") == F.col("last.key"), F.least("c", "last.left")).otherwise(F.lit(0))
    missing = tagged.where("more > 0").join(limits.select(*place), place, "left_anti").withColumn("again", F.lit(0).cast("long"))
    columns = ["doc_id", "key", "size", "source_size", "target", "rounds", "c", "again"]
    done = chosen.withColumn("again", again.cast("long")).select(*columns).union(missing.select(*columns)).union(tagged.where("more <= 0").withColumn("again", F.lit(0).cast("long")).select(*columns))
    return _each(done).select("doc_id", "key", "size", "source_size", "target", ((F.col("rounds") + F.when(F.col("copy") <= F.col("again"), 1).otherwise(0)) * F.col("size")).cast("long").alias("taken"))


def _each(rows: DataFrame) -> DataFrame:
    """A row for each of `c` copies, numbered by `copy`; many copies of one row are dealt over tasks by GROUP."""
    alone = rows.where("c = 1").withColumn("copy", F.lit(1).cast("long"))
    parts = rows.where("c > 1").withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"), F.lit(GROUP).cast("long"))))
    dealt = parts.repartition(fan_out(rows.sparkSession), "key", "at")
    return alone.union(dealt.withColumn("copy", F.explode(F.sequence("at", F.least(F.col("c"), F.col("at") + GROUP - 1)))).drop("at"))


def _code(source: str) -> Column:
    """A source as a string that is never null."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", "text", F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("key"))


def op9_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix: each row of docs as often as it is taken (a document taken no word goes).

    Nulls, empty and long texts, repeated rows and an empty table as for `decided`. All columns of docs stay, extra
    ones too, but for names that start with `__`."""
    taken = decided(docs, seed).where("size > 0").groupBy(F.col("key").alias("__own")).agg(F.sum(F.expr("taken div size")).alias("__total"), F.count("*").alias("__rows")).where("__total > 0")
    keyed = docs.withColumn("__own", F.xxhash64(F.lit(seed), "doc_id", "source", "text"))
    out = keyed.join(taken.hint("shuffle_hash"), "__own")
    alone = out.where("__rows = 1").withColumn("__times", F.col("__total"))
    # rows that repeat share what their document is taken: whole rounds each, and the first few once more
    turn = F.row_number().over(Window.partitionBy("__own").orderBy("__own"))
    shared = out.where("__rows > 1").withColumn("__turn", turn).withColumn("__times", F.expr("__total div __rows + IF(__turn <= __total % __rows, 1, 0)")).drop("__turn")
    both = alone.unionByName(shared).where("__times > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*[F.col(c) for c in docs.columns])
