"""The exact similarity top-k join against brute force, what it compares, and hot groups and words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.report_queries import jaccard_pairs
from lodestone.operators.similarity import places, similar_topk

ROWS = "g string, id long, asked boolean, s array<string>, words string, n int"


def naive(rows, k):
    out = {}
    for g, i, asked, s in rows:
        if asked and s:
            found = []
            for h, j, _, t in rows:
                if g == h and i != j and (both := len(set(s) & set(t or [])) if s else 0):
                    found.append((-round(both / len(set(s) | set(t)), 9), j))
            out |= {(g, i, r + 1): (j, -v) for r, (v, j) in enumerate(sorted(found)[:k])}
    return out


def got(df):
    return {(r["g"], r["id"], r["rank"]): (r["peer"], round(r["jaccard"], 9)) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_topk_against_brute_force(spark, seed):
    """Zipf words, duplicates and ties, sets from none to many words, some that do not ask, groups of one and a null group."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 300)}"
    rows, groups = [], ["a"] * 6 + ["b", None]
    for i in range(240):
        s = [word() for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 60]))]
        rows.append((rng.choice(groups), i, rng.random() < 0.8, s))
    rows += [(rows[5][0], 1000 + i, True, rows[5][3]) for i in range(15)] + [("lonely", 1, True, ["w1"]), ("a", 2000, True, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(3)
    for k in (1, 10):
        assert got(similar_topk(df, k)) == naive([(g, i, a, list(dict.fromkeys(s or []))) for g, i, a, s in rows], k)


def test_topk_of_nothing(spark):
    assert similar_topk(spark.createDataFrame([], ROWS)).collect() == []
    assert similar_topk(spark.createDataFrame([("a", 1, None, ["x"], "", 1), ("a", 2, None, ["x"], "", 1)], ROWS)).collect() == []


def test_pairs_that_cannot_be_among_the_best_are_not_compared(spark):
    """The documents of sf0.01 as sets of words, of which every two share some: with the true kth results as bounds the three
    filters leave 28 in 100 of the pairs; copies with edits, as a corpus has them, leave few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(F.lit("all").alias("g"), F.col("doc_id").alias("id"), F.lit(True).alias("asked"), X.word_set(F.col("text")).alias("s")).cache()
    third, share = rows.where("id % 3 = 0"), {}
    copies = third.unionByName(third.withColumn("id", F.col("id") + 10_000)).unionByName(third.withColumns({"id": F.col("id") + 20_000, "s": F.array_append("s", "more")}))
    for name, k, df in (("best 10", 10, rows), ("the best, every set with two copies", 2, copies)):
        formed = []
        top = got(similar_topk(df, k, formed))
        data = {r["id"]: frozenset(r["s"] or ()) for r in df.collect()}
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*data.values())))}
        m = np.zeros((len(data), len(vocabulary)), np.float32)
        for i, words in enumerate(data.values()):
            m[i, [vocabulary[w] for w in words]] = 1
        sharing = int(((m @ m.T) > 0).sum()) - int((m.sum(1) > 0).sum())
        share[name] = sum(f.count() for f in formed) / sharing
        print(name, share[name], "of", sharing)
        for i in sorted(data)[::37]:
            found = sorted((-round(len(data[i] & t) / len(data[i] | t), 9), j) for j, t in data.items() if j != i and data[i] & t)[:k]
            assert [top.get(("all", i, r + 1)) for r in range(len(found))] == [(j, -v) for v, j in found]
    assert share["best 10"] < 0.6 and share["the best, every set with two copies"] < 0.1


def test_places(spark):
    rows = [("a", i) for i in range(500, 0, -1)] + [("b", 7), (None, 1)]
    at = {(r["g"], r["id"]): (r["place"], r["size"]) for r in places(spark.createDataFrame([r for r in rows if r[0]], "g string, id long")).collect()}
    assert at == {("a", i): (i, 500) for i in range(1, 501)} | {("b", 7): (1, 1)}


def test_jaccard_pairs_gives_every_pair_that_shares_a_word(spark):
    """More sets share a word than a block or a list of ten holds: each pair is there once, a < b."""
    rng = random.Random(3)
    rows = [(i, sorted({"all", *(f"w{rng.randrange(40)}" for _ in range(rng.randrange(6)))})) for i in range(300)] + [(300, ["alone"]), (301, []), (302, None)]
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in jaccard_pairs(spark.createDataFrame(rows, "id long, s array<string>")).collect()}
    sets = {i: set(s or []) for i, s in rows}
    assert got == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and sets[a] & sets[b]}
