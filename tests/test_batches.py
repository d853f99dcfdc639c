"""Batches under failures: they converge, and a rerun asks nothing twice."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import batches as B
from lodestone.operators import report_queries as R


class Provider:
    """Answers id i at its attempt number i % 4 (never, for 3 in 4 with three attempts), and remembers what it was asked."""

    def __init__(self, dies=None):
        self.asked, self.dies = [], dies

    def __call__(self, rows):
        self.asked += [(r["id"], r["attempt"]) for r in rows.collect()]
        if self.dies is not None and len(self.asked) > self.dies:
            raise RuntimeError("killed")
        ok = F.col("id") % 4 == F.col("attempt")
        said = rows.select("id", F.when(ok, F.concat("body", F.lit("!"))).alias("body"), F.when(~ok, "HTTP 500").alias("error"))
        return said.where("id % 10 <> 9 OR body IS NOT NULL")  # some failures are silence


def want():
    return {i: (f"q{i}!", i % 4) for i in range(30) if i % 4 < 3}


def test_fixpoint(spark, tmp_path):
    path = str(tmp_path / "out")
    requests = spark.createDataFrame([(i, f"q{i}") for i in range(30)] + [(3, "q3"), (None, "x")], "id long, body string")
    ask = Provider()
    held = B.run_to_fixpoint(requests, "id", ask, path, attempts=3, chunk=4, wave=2)
    assert {r["id"]: (r["body"], r["attempt"]) for r in B.answers(requests, "id", held).collect()} == want()
    assert len(ask.asked) == len(set(ask.asked)) == 30 + 22 + 14
    states = B.chunk_states(held).collect()
    assert sum(r["n"] for r in states) == 66 and sum(r["n_ok"] for r in states) == 23 and max(r["n"] for r in states) == 4
    again = Provider()
    B.run_to_fixpoint(requests, "id", again, path, attempts=3, chunk=4)
    assert again.asked == []
    B.run_to_fixpoint(requests, "id", again, path, attempts=4, chunk=4)
    assert {i for i, _ in again.asked} == {i for i in range(30) if i % 4 == 3} and B.answers(requests, "id", held).count() == 30


def test_killed_in_a_wave(spark, tmp_path):
    """The next run asks that wave again, and none before it."""
    path = str(tmp_path / "out")
    requests = spark.createDataFrame([(i, f"q{i}") for i in range(30)], "id long, body string")
    first, second = Provider(dies=20), Provider()
    with pytest.raises(RuntimeError, match="killed"):
        B.run_to_fixpoint(requests, "id", first, path, attempts=3, chunk=4, wave=2)
    held = B.run_to_fixpoint(requests, "id", second, path, attempts=3, chunk=4, wave=2)
    lost = set(first.asked) & set(second.asked)
    assert len(lost) == 8 and len(second.asked) == len(set(second.asked)) == 66 - 16
    assert {r["id"]: (r["body"], r["attempt"]) for r in B.answers(requests, "id", held).collect()} == want()


def test_no_requests(spark, tmp_path):
    requests = spark.createDataFrame([], "id long, body string")
    held = B.run_to_fixpoint(requests, "id", Provider(), str(tmp_path / "out"))
    assert held.last() == -1 and B.answers(requests, "id", held).count() == 0


def test_evidence_texts(spark):
    """In the item's order, unknown and null ids as empty texts, repeats kept, long texts cut; no evidence is an empty list."""
    items = spark.createDataFrame([(1, ["b", "a", "b", "zz", None]), (2, []), (3, None), (4, ["long"])], "item long, evidence array<string>")
    passages = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("long", "x" * 50), ("", "never")], "passage_id string, text string")
    got = {r["item"]: [(e["passage_id"], e["text"]) for e in r["evidence"]] for r in R.evidence_texts(items, passages, 10).collect()}
    assert got[1] == [("b", "B"), ("a", "A"), ("b", "B"), ("zz", ""), (None, "")] and got[2] == got[3] == []
    assert got[4][0][0] == "long" and got[4][0][1].startswith("x" * 9) and len(got[4][0][1]) <= 11


def test_evidence_in_slices(spark, monkeypatch):
    """Each item is in one part, with what it has when all are made together; a part's texts are bounded."""
    items = spark.createDataFrame([(i, [str(i % 7), str((i + 1) % 7), "none"]) for i in range(60)] + [(100, None)], "item long, evidence array<string>")
    passages = spark.createDataFrame([(str(i), "x" * 100) for i in range(7)], "passage_id string, text string")
    whole = sorted((r["item"], r["evidence"]) for r in R.evidence_texts(items, passages).collect())
    monkeypatch.setattr(R, "SLICE", 4000)
    parts = [p.collect() for p in R.evidence_slices(items, passages)]
    assert len(parts) == 3 and all(parts)
    assert sorted((r["item"], r["evidence"]) for p in parts for r in p) == whole
