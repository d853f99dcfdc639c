"""The learned encoder spans what an exact decomposition spans, and finds more than hashed counts."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import encoder as E
from lodestone.operators import retrieval_queries as R
from lodestone.plans.joins import stable
from lodestone.plans.tables import table

TOPICS = ["sun moon star sky orbit", "bread milk flour oven salt", "king law court judge crown"]


def corpus():
    rng = np.random.default_rng(5)
    return [(i, " ".join(rng.choice(TOPICS[i % 3].split(), 6 + i % 4))) for i in range(30)] + [(30, "sun bread king lonely"), (31, ""), (32, None), (33, "nowhere")]


def exact(rows, dims):
    tf = {i: Counter((t or "").split()) for i, t in rows}
    df = Counter(t for c in tf.values() for t in c)
    vocab = sorted(t for t, n in df.items() if n > 1)
    a = np.array([[(1 + math.log(c[t])) * math.log((len(rows) + 1) / df[t]) if c[t] else 0.0 for t in vocab] for c in tf.values()])
    a = np.divide(a, np.linalg.norm(a, axis=1, keepdims=True), out=np.zeros_like(a), where=a.any(axis=1, keepdims=True))
    e = a @ np.linalg.svd(a, full_matrices=False)[2][:dims].T
    return np.divide(e, np.linalg.norm(e, axis=1, keepdims=True), out=np.zeros_like(e), where=a.any(axis=1, keepdims=True))


def test_spans_the_leading_directions(spark):
    rows = corpus()
    texts = spark.createDataFrame(rows, "id long, text string")
    model = stable(E.fit(texts, 3, rounds=10))
    got = {r["id"]: r["embedding"] for r in E.encode(texts, model).collect()}
    assert sorted(got) == [i for i, _ in rows] and got[31] == got[32] == got[33] == []
    mine = np.array([got[i] or [0.0] * 3 for i, _ in rows])
    want = exact(rows, 3)
    assert np.abs(mine @ mine.T - want @ want.T).max() < 1e-4
    assert model.where("token IN ('lonely', 'nowhere')").count() == 0


def test_few_directions_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b")], "id long, text string")
    model = stable(E.fit(texts, 8, 2))
    assert {len(r["v"]) for r in model.collect()} == {1}
    assert all(abs(abs(r["embedding"][0]) - 1) < 1e-6 for r in E.encode(texts, model).collect())
    none = E.fit(texts.limit(0), 8, 2)
    assert none.count() == 0 and [r["embedding"] for r in E.encode(texts.limit(1), none).collect()] == [[]]


def test_recall_beats_hashed_counts(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    qrels = stable(R.verbatim(docs.withColumnRenamed("id", "doc_id"), items.withColumnRenamed("id", "qid")))

    def recall(v, q):
        run = R.dense(v.select(F.col("id").alias("doc_id"), "embedding"), q.select(F.col("id").alias("qid"), "embedding"), 10)
        return {r["metric"]: r["value"] for r in R.metrics(run, qrels).collect()}["recall@10"]

    model = stable(E.fit(docs, R.DIMS))
    learned = recall(*[stable(E.encode(x, model).where("size(embedding) > 0")) for x in (docs, items)])
    assert learned > recall(R.hashed_vectors(docs), R.hashed_vectors(items))


def test_what_is_kept_is_columns(spark):
    """Counts, weights and bases are kept as compressed columns, a few times smaller than checkpointed rows."""
    model = E.fit(spark.createDataFrame(corpus(), "id long, text string"), 3, 1)
    plan = model._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan


def test_blocks_and_slices_of_any_size_agree(spark, monkeypatch):
    """Texts are packed into blocks, whose tokens' vectors travel some dimensions at a time; rows of one id are one text."""
    for name, value in (("BLOCK_WORDS", 12), ("TEXTS", 3), ("TOKENS", 4), ("SLICE", 2), ("BLOCK_CHARS", 100)):
        monkeypatch.setattr(E, name, value)
    rows = corpus()
    halves = [(i, t) for i, t in rows if not t or len(t.split()) < 2] + [(i, h) for i, t in rows if t and len(t.split()) > 1 for h in (" ".join(t.split()[:2]), " ".join(t.split()[2:]))]
    model = stable(E.fit(spark.createDataFrame(halves, "id long, text string"), 3, rounds=10))
    texts = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["embedding"] for r in E.encode(texts, model).collect()}
    mine, want = np.array([got[i] or [0.0] * 3 for i, _ in rows]), exact(rows, 3)
    assert np.abs(mine @ mine.T - want @ want.T).max() < 1e-4
