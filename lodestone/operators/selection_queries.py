"""Coverage-aware selection: the sequential greedy, the same over pools of any size, and threshold rounds."""

from __future__ import annotations

import heapq
import math
import pickle
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import COMMON, greedy_in_batches, rounds_in_passes
from lodestone.operators.candidates import inverse_agreement
from lodestone.operators.metrics_queries import QA, qa_evidence
from lodestone.operators.retrieval_queries import _items, verbatim
from lodestone.operators.text_queries import SALIENCE, salience
from lodestone.plans.catalog import query
from lodestone.plans.tables import table

MOST = 2048  # items of a pool that a task passes on, of which the next picks are taken
LINES = 400_000  # lines that a task groups by order
#: Weights of new documents, new units, a new reason, and of likeness to what is picked.
SETTINGS = {
    "main": (1.0, 1.0, 0.5, 0.2),
    "doc_only": (1.0, 0.0, 0.0, 0.2),
    "unit_only": (0.0, 1.0, 0.0, 0.2),
    "no_reason": (1.0, 1.0, 0.0, 0.2),
    "no_redundancy": (1.0, 1.0, 0.5, 0.0),
}


def coded(lists: list) -> list[list[int]]:
    """Lists of values, one an item, as lists of small integers, each once, nulls left out."""
    codes: dict = {}
    return [sorted({codes.setdefault(v, len(codes)) for v in (() if x is None else x) if v is not None}) for x in lists]


class Gains:
    """What an item would add to the items picked so far: covered documents, units and reasons are sets of codes, and a
    posting list a token says which picked items are like it."""

    def __init__(self, docs: list, units: list, reasons: list, tokens: list, weights: tuple):
        self.weights = weights
        self.parts = [coded(x) for x in (docs, units, [[r] if r else [] for r in reasons])]
        self.covered: list[set] = [set(), set(), set()]
        self.tokens = list(map(frozenset, coded(tokens)))
        self.postings: dict[int, list[int]] = defaultdict(list)

    def likeness(self, i: int) -> float:
        """The largest Jaccard similarity to a picked item that shares a token of at most COMMON postings."""
        own, lists = self.tokens[i], self.postings
        near = {j for t in own if t in lists and len(lists[t]) <= COMMON for j in lists[t]}
        return max((both / (len(own) + len(self.tokens[j]) - both) for j in near if (both := len(own & self.tokens[j]))), default=0.0)

    def of(self, i: int) -> float:
        gain = sum(w * sum(v not in c for v in p[i]) for w, p, c in zip(self.weights, self.parts, self.covered, strict=False) if w)
        return gain - self.weights[3] * self.likeness(i) if self.weights[3] and self.tokens[i] else gain

    def pick(self, i: int) -> None:
        for p, c in zip(self.parts, self.covered, strict=True):
            c.update(p[i])
        for t in self.tokens[i]:
            self.postings[t].append(i)


def greedy(docs: list, units: list, reasons: list, tokens: list, unknown: list, n: int, weights=SETTINGS["main"], least_unknown: float = 0.0) -> list[tuple[int, float]]:
    """(item, gain) in the order picked: n items, of which the first ceil(n * least_unknown) are unknown ones if
    there are as many.

    Gains are upper bounds until an item comes up, when it is weighed anew: it is picked if no bound that is left
    beats it by more than 1e-12, else it goes back. Of equal bounds the lower index comes up first. A gain can grow
    when a token turns common, so bounds are the ones last weighed, not proven ones."""
    gains, picked = Gains(docs, units, reasons, tokens, weights), []
    for wanted, limit in ((True, min(n, math.ceil(n * least_unknown))), (False, n)):
        done = {i for i, _ in picked}
        bounds = [(-gains.of(i), i) for i in range(len(docs)) if i not in done and (unknown[i] or not wanted)] if len(picked) < limit else []
        heapq.heapify(bounds)
        while bounds and len(picked) < limit:
            _, i = heapq.heappop(bounds)
            now = gains.of(i)
            if bounds and now + 1e-12 < -bounds[0][0]:
                heapq.heappush(bounds, (-now, i))
            else:
                gains.pick(i)
                picked.append((i, now))
    return picked


def _picks(states: DataFrame, group: str) -> DataFrame:
    """(group, item, rank, gain) from the pools' states."""

    def run(frames):
        for pdf in frames:
            for g, state in zip(pdf[group], pdf["state"], strict=True):
                picks = pickle.loads(state)["picks"]
                yield pd.DataFrame({group: [g] * len(picks), "item": [p["key"][-1] for p in picks], "rank": range(1, len(picks) + 1), "gain": [round(p["gain"], 6) for p in picks]})

    return states.select(group, "state").mapInPandas(run, f"{group} {states.schema[group].dataType.simpleString()}, item long, rank int, gain double")


def select_each(pool: DataFrame, group: str, n: int, weights: list[tuple], order: list | None = None, least_unknown: float = 0.0, most: int = MOST) -> list[DataFrame]:
    """select() for each of the weights, over one packing of the pool."""
    return [_picks(states, group) for states in greedy_in_batches(pool, group, n, order or ["item"], weights, least_unknown, most)]


def select(pool: DataFrame, group: str, n: int, order: list | None = None, weights: tuple = SETTINGS["main"], least_unknown: float = 0.0, most: int = MOST) -> DataFrame:
    """pool (group, item, pids, units, reason, words, unknown) -> (group, item, rank, gain): what greedy() picks of each
    pool, pick by pick, for pools that no task holds.

    Ties go by `order`, whole numbers that end with the item (the item alone by default). See blocks.greedy_in_batches.
    Values that are not whole numbers are told apart by 64-bit hashes. greedy() takes gains that differ by less than 1e-12
    for equal; here they differ."""
    return select_each(pool, group, n, [weights], order, least_unknown, most)[0]


def select_in_rounds(pool: DataFrame, n: int, weights: tuple = SETTINGS["main"], least_unknown: float = 0.0, near: float = 0.8, least: float = 0.05, most: int = MOST) -> DataFrame:
    """(pool, item, round): n items a pool (all, if fewer) of (pool, item, pids, units, reason, words, unknown), for pools
    that no task holds.

    The gain is the greedy's: weighted new documents, units and reasons, less the likeness to what is picked. A round
    takes items whose gain is at least `near` of their pool's best, counting each document, unit and reason for one item of
    the round only (the one with the largest gain). The best item counts all of its own, so each round picks; once
    the best gain is below `least`, the best items that are left fill the pool. Likeness is to the picks of earlier rounds, by
    token postings of at most COMMON items. The first ceil(n * least_unknown) picks are unknown, if there are as many.

    An item is unique in its pool; a null pool takes no part, nor do nulls in the lists. Rounds are numbered in each pool. A
    round is one pass over the blocks of blocks.packed, or more where the best `most` items of a pool don't settle it."""

    def run(frames):
        for pdf in frames:
            for g, state in zip(pdf["pool"], pdf["state"], strict=True):
                picks = pickle.loads(state)["picks"]
                yield pd.DataFrame({"pool": [g] * len(picks), "item": [p["key"][-1] for p in picks], "round": [p["round"] for p in picks]})

    states = rounds_in_passes(pool.where("pool IS NOT NULL"), "pool", n, weights, least_unknown, near, least, most)
    return states.select("pool", "state").mapInPandas(run, f"pool {states.schema['pool'].dataType.simpleString()}, item long, round int")


def _pool(spark, d) -> DataFrame:
    """Orders as items, parts as documents, brands as units; an item's tokens are the words of its parts' names.

    What metrics_queries.qa_evidence has, grouped by item. Lines meet their parts first and are dealt by order once, for
    the join with the orders and for the groups; neither join sorts the lines. Tasks get more, not larger, as lines do: a
    task holds its orders for the join, sorts its lines for the groups and packs its items."""
    tasks = -(-table(spark, d, "lineitem").count() // LINES)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.lower(F.trim("o_orderpriority")).alias("reason"), (F.col("o_orderstatus") == "F").alias("unknown"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("pid"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("unit"), F.lower("p_name").alias("name"))
    lines = e.join(p.hint("shuffle_hash"), "pid", "left")
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(tasks, "item")
    g = lines.join(o.hint("shuffle_hash"), "item").groupBy("item", "reason", "unknown").agg(F.collect_set("pid").alias("pids"), F.collect_set("unit").alias("units"), F.collect_set("name").alias("names"))
    words = F.array_distinct(F.flatten(F.transform("names", lambda x: F.split(x, " "))))
    return g.withColumn("words", words).drop("names").withColumn("pool", F.concat(F.lit("p"), F.col("item") % 8))


@query("select_greedy")
def _select(spark, d):
    return select(_pool(spark, d), "pool", 50)


@query("select_ablations")
def _ablations(spark, d):
    each = select_each(_pool(spark, d), "pool", 50, list(SETTINGS.values()))
    return reduce(DataFrame.union, (one.withColumn("setting", F.lit(name)) for name, one in zip(SETTINGS, each, strict=True)))


@query("select_unknown_first")
def _unknown(spark, d):
    return select(_pool(spark, d), "pool", 50, least_unknown=0.5)


@query("select_b1")
def _b1(spark, d):
    """Documents first, without regard to unknownness; ties in the order of a hash."""
    turn = F.md5(F.concat(F.lit("b1"), F.col("item").cast("string")))
    half = lambda start: F.conv(F.substring(turn, start, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  (ascending as the digits are)
    pool = _pool(spark, d).withColumn("turn", half(1)).withColumn("rest", half(17))
    return select(pool, "pool", 50, order=["turn", "rest", "item"], weights=SETTINGS["doc_only"])


@query("select_unit_first")
def _unit_first(spark, d):
    return select(_pool(spark, d), "pool", 50, weights=SETTINGS["unit_only"])


@query("select_retarget")
def _retarget(spark, d):
    """Unknown by another model's flags; an item that it did not score is not unknown."""
    flags = table(spark, d, "labels").select(F.col("doc_id").alias("item"), ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("other"))
    pool = _pool(spark, d).join(flags, "item", "left").withColumn("unknown", F.coalesce("other", F.lit(False)))
    return select(pool, "pool", 50, least_unknown=0.5)


@query("select_in_rounds")
def _rounds(spark, d):
    """The same pools and numbers as select_greedy, without a task that holds a pool."""
    return select_in_rounds(_pool(spark, d), 50)


@query("select_paraphrase", f"WITH {QA}, s AS (SELECT DISTINCT item, 1 - least(1, greatest(0, CASE WHEN item % 7 = 0 THEN 1 ELSE (item % 113) / 100::DOUBLE END)) AS score FROM qa) SELECT item, round(score, 6) + 0.0 AS score FROM s ORDER BY round(score, 9) DESC, item LIMIT 500")
def _paraphrase(spark, d):
    agree = F.when(F.col("item") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("item") % 113) / 100)
    s = qa_evidence(spark, d).select("item").distinct().select("item", inverse_agreement(agree).alias("score"))
    return s.orderBy(F.desc(F.round("score", 9)), "item").limit(500).select("item", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("select_long_tail", SALIENCE + ", e AS (SELECT item_id AS item, d.doc_id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)), i AS (SELECT item, avg(coalesce(rarity, 0)) AS score FROM e LEFT JOIN s USING (doc_id) GROUP BY item) SELECT item, round(score, 6) + 0.0 AS score FROM i ORDER BY round(score, 9) DESC, item LIMIT 500")
def _long_tail(spark, d):
    """Items by the mean rarity of their evidence; what has none scores 0."""
    docs, items = table(spark, d, "documents"), _items(spark, d)
    e = items.select("qid").join(verbatim(docs.select("doc_id", "text"), items), "qid", "left")
    s = e.join(salience(docs).select("doc_id", "rarity"), "doc_id", "left").groupBy(F.col("qid").alias("item")).agg(F.avg(F.coalesce("rarity", F.lit(0.0))).alias("score"))
    return s.orderBy(F.desc(F.round("score", 9)), "item").limit(500).select("item", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("unit_filter", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 40 AND coalesce(source, '') <> ''")
def _unit_filter(spark, d):
    """Units long enough to ask about, with an id."""
    return table(spark, d, "documents").where("length(text) >= 40 AND coalesce(source, '') <> ''").select("doc_id", F.length("text").cast("long").alias("n"))
