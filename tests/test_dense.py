"""Dense search against brute force: cells, ties, and vectors that have no score."""

import numpy as np

from lodestone.operators import retrieval_queries as R


def test_cells_against_brute_force(spark, monkeypatch):
    """More cells than one, copies that tie, a vector of zeros, null vectors and ones that hold a null or are shorter."""
    monkeypatch.setattr(R, "CELL", 50)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(180)]
    rows += [(200 + i, rows[7][1]) for i in range(9)] + [(300, [0.0] * 6), (301, None), (302, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (303, [1.0, 2.0]), (None, [1.0] * 6)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(5)
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in R.dense(v, v.where("doc_id % 2 = 0 OR doc_id > 300").withColumnRenamed("doc_id", "qid"), 8).collect()}
    plain = {i: np.array(x, float) for i, x in rows if i is not None and x and None not in x}
    unit = {i: x / (np.sqrt(x @ x) or 1) for i, x in plain.items()}
    for i, _ in rows:
        if i is not None and (i % 2 == 0 or i > 300):
            scores = [(j, unit[i] @ unit[j] if i in unit and j in unit and len(unit[i]) == len(unit[j]) else None) for j, _ in rows if j not in (None, i)]
            want = sorted(scores, key=lambda x: (x[1] is None, -round(x[1], 9) if x[1] is not None else 0, x[0]))[:8]
            found = [got[(i, r + 1)] for r in range(8)]
            assert [x[0] for x in found] == [x[0] for x in want]
            assert all((a is None and b is None) or abs(a - b) < 1e-9 for (_, a), (_, b) in zip(found, want, strict=True))


def test_nothing_to_search(spark):
    v = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>")
    assert R.dense(v, v.withColumnRenamed("doc_id", "qid"), 3).count() == 0
    assert R.dense(v.limit(0), v.withColumnRenamed("doc_id", "qid"), 3).count() == 0


def test_no_side_is_broadcast(spark):
    """A small query set must not be sent whole to every task by way of the driver, repeated for each part of the vectors."""
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "doc_id long, embedding array<float>")
    run = R.dense(v, v.withColumnRenamed("doc_id", "qid"), 3)
    run.collect()
    assert "Broadcast" not in run._jdf.queryExecution().executedPlan().toString()
