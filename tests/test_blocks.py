"""Selection over pools that no task holds, against the sequential greedy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocks as B
from lodestone.operators import metrics_queries as M
from lodestone.operators import selection_queries as S


def rows(rng, m, words=12):
    some = lambda k, top: sorted({f"{k}{rng.randrange(top)}" for _ in range(rng.randint(0, 4))})
    return [(i, some("d", 30), some("u", 8), rng.choice(["a", "b", "", None]), some("t", words), rng.random() < 0.5) for i in range(m)]


def as_block(items):
    codes: dict = {}
    lists = {}
    for k, at in (("docs", 1), ("units", 2), ("reasons", 3), ("tokens", 4)):
        own = [([r[at]] if r[at] else []) if k == "reasons" else r[at] for r in items]
        lists[k] = B.Lists.of(np.array([codes.setdefault((k, v), len(codes)) for o in own for v in o], np.int64), np.array([len(o) for o in own], np.int64))
    return B.Block(np.array([[r[0] for r in items]], np.int64), np.array([r[5] for r in items], bool), lists)


def in_passes(block, weights, n, share, most, parts):
    """(item, gain) as passes over `parts` blocks pick them, and the number of passes."""
    limit = min(n, math.ceil(n * share))
    state, passes = B.fresh(n, limit), 0
    cuts = [block.take(np.arange(k, len(block), parts)) for k in range(min(parts, len(block)))]
    while not state["done"]:
        seen = [B.weighed(c, state, weights) for c in cuts]
        state = B.picked_batch(state, B.Found.joined([f.best(most) for f in seen]).best(most), B.answer(seen, state), weights, n, limit)
        passes += 1
    return [(p["key"][-1], p["gain"]) for p in state["picks"]], passes


@pytest.mark.parametrize("common", [200, 3])
def test_passes_pick_what_the_greedy_picks(monkeypatch, common):
    """Pick by pick, ties and tokens that turn common included, from many blocks and few candidates a pass."""
    monkeypatch.setattr(B, "COMMON", common)
    monkeypatch.setattr(S, "COMMON", common)
    rng = random.Random(5)
    for _ in range(25):
        items = rows(rng, rng.randint(1, 40), rng.choice([3, 12]))
        n, weights, share = rng.randint(1, len(items) + 3), rng.choice(list(S.SETTINGS.values())), rng.choice([0.0, 0.5, 1.0])
        want = S.greedy(*([r[k] for r in items] for k in range(1, 6)), n, weights, share)
        for most in (1, 3, 100):
            got, passes = in_passes(as_block(items), weights, n, share, most, rng.randint(1, 5))
            assert [i for i, _ in got] == [i for i, _ in want]
            assert [g for _, g in got] == pytest.approx([g for _, g in want])
            assert passes <= 2 * n + 4


def test_select_over_partitions(spark):
    """Two pools over seven partitions, none of which holds one; a null pool; an order of its own."""
    rng = random.Random(8)
    items = [(g, r[0] * 10 + k, *r[1:], -r[0]) for k, g in enumerate(("a", "b", None)) for r in rows(rng, 60)]
    schema = "pool string, item long, pids array<string>, units array<string>, reason string, words array<string>, unknown boolean, turn long"
    data = spark.createDataFrame(items, schema).repartition(7)
    for order, share, most in ((None, 0.0, 4), (["turn", "item"], 0.5, 5)):
        got = {}
        for r in S.select(data, "pool", 20, order, least_unknown=share, most=most).collect():
            got.setdefault(r["pool"], []).append((r["rank"], r["item"], r["gain"]))
        for g in ("a", "b", None):
            own = sorted((r for r in items if r[0] == g), key=lambda r: (r[7], r[1]) if order else r[1])
            want = S.greedy(*([r[k] for r in own] for k in range(2, 7)), 20, least_unknown=share)
            assert sorted(got[g]) == [(k + 1, own[i][1], round(x, 6)) for k, (i, x) in enumerate(want)]


def plain_rounds(items, weights, n, share, near=0.8, least=0.05):
    """[(item, round)] worked out anew from the rule of select_in_rounds."""
    by = {r[0]: [[("d", v) for v in r[1]], [("u", v) for v in r[2]], [("r", r[3])] if r[3] else []] for r in items}
    words, unknown = {r[0]: set(r[4]) for r in items}, {r[0]: r[5] for r in items}
    picked, covered, like, number = [], set(), dict.fromkeys(by, 0.0), 0
    for only, goal in ((True, min(n, math.ceil(n * share))), (False, n)):
        while len(picked) < goal:
            left = [i for i in by if i not in {p for p, _ in picked} and (unknown[i] or not only)]
            if not left:
                break
            gain = {i: sum(w * sum(v not in covered for v in part) for w, part in zip(weights, by[i], strict=False) if w) - weights[3] * like[i] for i in left}
            top = max(gain.values())
            able = sorted((i for i in left if top < least or gain[i] >= near * top), key=lambda i: (-gain[i], i))
            owned, worth = set(), {}
            for i in able:
                mine = [w * sum(v not in covered | owned for v in part) for w, part in zip(weights, by[i], strict=False) if w]
                owned |= {v for part in by[i] for v in part}
                worth[i] = gain[i] if top < least else sum(mine) - weights[3] * like[i]
            fit = sorted((i for i in able if top < least or worth[i] >= near * top - 1e-9), key=lambda i: (-worth[i], i))[: goal - len(picked)]
            number += 1
            picked += [(i, number) for i in fit]
            covered |= {v for i in fit for part in by[i] for v in part}
            often = np.unique([t for i, _ in picked for t in words[i]], return_counts=True)
            rare = {t for t, k in zip(*often, strict=True) if k <= B.COMMON}
            like = {i: max([like[i], *(len(words[i] & words[j]) / len(words[i] | words[j]) for j in fit if words[i] & words[j] & rare)]) for i in by}
    return picked


@pytest.mark.parametrize("common", [200, 3])
def test_passes_make_the_rounds(monkeypatch, common):
    """Round by round, from many blocks, where a round's best few items settle it and where they don't."""
    monkeypatch.setattr(B, "COMMON", common)
    rng = random.Random(6)
    for _ in range(40):
        items = rows(rng, rng.randint(1, 40), rng.choice([3, 12]))
        n, weights, share = rng.randint(1, len(items) + 3), rng.choice(list(S.SETTINGS.values())), rng.choice([0.0, 0.5])
        limit, block = min(n, math.ceil(n * share)), as_block(items)
        for most in (1, 3, 100):
            state = {"picks": [], "round": 0, "only_unknown": limit > 0, "done": False, "most": most}
            cuts = [block.take(np.arange(k, len(block), 3)) for k in range(min(3, len(block)))]
            while not state["done"]:
                seen = [B.look_at_round(c, state, weights) for c in cuts]
                state = B.step_of_round(state, {f: [s[f] for s in seen if f in s] for f in (False, True)}, weights, n, limit, 0.8, 0.05, most)
            assert [(p["key"][-1], p["round"]) for p in state["picks"]] == plain_rounds(items, weights, n, share)


def in_whole_passes(block, weights, n, share, most, parts):
    """(item, gain) as greedy_in_batches picks them, and the number of passes."""
    limit = min(n, math.ceil(n * share))
    state, passes = B.fresh(n, limit), 0
    cuts = [block.take(np.arange(k, len(block), parts)) for k in range(min(parts, len(block)))]
    while not state["done"]:
        seen = [B.best_and_lasts([(f := B.weighed(c, state, weights), B.Lasts(f, -math.inf))], state, most) for c in cuts]
        state = B.picked_batch(state, *B.best_and_lasts(seen, state, most), weights, n, limit)
        passes += 1
    return [(p["key"][-1], p["gain"]) for p in state["picks"]], passes


@pytest.mark.parametrize("common", [200, 3])
def test_passes_with_the_last_of_each_bound(monkeypatch, common):
    """They pick what the greedy picks too, and never need more passes than by asking."""
    monkeypatch.setattr(B, "COMMON", common)
    monkeypatch.setattr(S, "COMMON", common)
    rng = random.Random(7)
    for _ in range(12):
        items = rows(rng, rng.randint(1, 40), rng.choice([3, 12]))
        n, weights, share = rng.randint(1, len(items) + 3), rng.choice(list(S.SETTINGS.values())), rng.choice([0.0, 0.5, 1.0])
        want = S.greedy(*([r[k] for r in items] for k in range(1, 6)), n, weights, share)
        for most in (1, 4):
            parts = rng.randint(1, 5)
            got, passes = in_whole_passes(as_block(items), weights, n, share, most, parts)
            assert [i for i, _ in got] == [i for i, _ in want]
            assert [g for _, g in got] == pytest.approx([g for _, g in want])
            assert passes <= in_passes(as_block(items), weights, n, share, most, parts)[1]


def test_units_first_takes_few_passes(spark, monkeypatch):
    """The last items of bounds come with a pass, so that falls of the best gain cost no pass of their own."""
    rng = random.Random(11)
    some = lambda k, top, m: sorted({f"{k}{rng.randrange(top)}" for _ in range(m)})
    items = [("a", i, [], some("u", 12, rng.randint(1, 4)), None, some("t", 9, rng.randint(1, 3)), False) for i in range(600)]
    data = spark.createDataFrame(items, "pool string, item long, pids array<string>, units array<string>, reason string, words array<string>, unknown boolean").repartition(3)
    passes, stable = [], B.stable
    monkeypatch.setattr(B, "stable", lambda df: passes.append(df) or stable(df))
    weights = S.SETTINGS["unit_only"]
    got = [(r["item"], r["gain"]) for r in S.select(data, "pool", 12, weights=weights, most=40).orderBy("rank").collect()]
    assert got == [(i, round(g, 6)) for i, g in S.greedy(*([r[k] for r in items] for k in range(2, 7)), 12, weights)]
    assert len(passes) - 1 <= 5


def test_few_blocks_are_passed_to_python_at_once(spark, monkeypatch):
    """A block has about a MB, so a batch of rows as long as Spark's default would hold all blocks of a task."""
    key, seen, stable = "spark.sql.execution.arrow.maxRecordsPerBatch", [], B.stable
    was = spark.conf.get(key)
    monkeypatch.setattr(B, "stable", lambda df: seen.append(spark.conf.get(key)) or stable(df))
    items = [("a", i, [f"d{i % 5}"], [], None, [], False) for i in range(20)]
    data = spark.createDataFrame(items, "pool string, item long, pids array<string>, units array<string>, reason string, words array<string>, unknown boolean")
    assert [r["item"] for r in S.select(data, "pool", 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert len(seen) > 1
    assert all(int(rows) <= 4 for rows in seen[1:])
    assert spark.conf.get(key) == was


def test_pool_deals_the_lines_once_by_order(spark):
    """The pool is what qa_evidence gives, grouped; the joins with orders and labels and the groups share one exchange."""
    d, key = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("p_name"), " ")))))
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("pid"), "p_name")
    e = M.qa_evidence(spark, d).join(names, "pid", "left").groupBy("item", "reason", "unknown")
    want = e.agg(F.array_sort(F.collect_set("pid")), F.array_sort(F.collect_set("unit")), words).collect()
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        pool = S._pool(spark, d)
        got = pool.select("item", "reason", "unknown", *[F.array_sort(c) for c in ("pids", "units", "words")]).collect()
        labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item"), "toxic")
        plan = pool.join(labels, "item", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, was)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert plan.count("Exchange hashpartitioning(") == 5  # lines and parts by part, lines, orders and labels by order


def test_pool_gets_more_tasks_with_more_lines(spark, monkeypatch):
    """Lines, not the session's partitions, say how many tasks group them; labels join in as many, and no row is lost."""
    d, key = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item"), "toxic")
    made = lambda: S._pool(spark, d).select("item", "reason", "unknown", *[F.array_sort(c).alias(c) for c in ("pids", "units", "words")]).join(labels, "item", "left")
    want, lines, was = made().collect(), spark.read.parquet(f"{d}/lineitem.parquet").count(), spark.conf.get(key)
    monkeypatch.setattr(S, "LINES", lines // 40)
    spark.conf.set(key, "-1")
    try:
        pool = made()
        got = pool.collect()
        tasks = [r["n"] for r in pool.groupBy(F.spark_partition_id()).agg(F.sum(F.size("pids")).alias("n")).collect()]
    finally:
        spark.conf.set(key, was)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(tasks) >= 35
    assert max(tasks) <= 2 * S.LINES


@pytest.mark.parametrize("gathered", [2, 100])
def test_finds_are_joined_before_a_pool_is_settled(spark, monkeypatch, gathered):
    """What the tasks of a pass find is joined by a few of them first, and the same is picked, by passes and by rounds."""
    rng = random.Random(9)
    items = [(g, r[0], *r[1:]) for g in ("a", None) for r in rows(rng, 60)]
    schema = "pool string, item long, pids array<string>, units array<string>, reason string, words array<string>, unknown boolean"
    data = spark.createDataFrame(items, schema).repartition(7)
    plans, stable = [], B.stable
    monkeypatch.setattr(B, "stable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stable(df))
    monkeypatch.setattr(B, "GATHERED", gathered)
    got = {}
    for r in S.select(data, "pool", 20, least_unknown=0.5, most=5).orderBy("rank").collect():
        got.setdefault(r["pool"], []).append((r["item"], r["gain"]))
    for g in ("a", None):
        own = [r[1:] for r in items if r[0] == g]
        assert got[g] == [(i, round(x, 6)) for i, x in S.greedy(*([r[k] for r in own] for k in range(1, 6)), 20, least_unknown=0.5)]
    assert len(plans) > 2
    assert all(("FlatMapGroupsInPandas" in p) == (gathered == 2) for p in plans[1:])
    rounds = S.select_in_rounds(data, 12, least_unknown=0.5, most=12).collect()
    own = [r[1:] for r in items if r[0] == "a"]
    assert sorted((r["item"], r["round"]) for r in rounds) == sorted(plain_rounds(own, S.SETTINGS["main"], 12, 0.5))
