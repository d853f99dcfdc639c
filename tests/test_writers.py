"""Two sinks and a call log under kills, repeats and torn lines."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import writers as W


def feed(spark, path, rows, files=3):
    spark.createDataFrame(rows, "id long, t string").repartition(files, "id").write.mode("append").parquet(path)
    return spark.readStream.schema("id long, t string").option("maxFilesPerTrigger", 1).parquet(path)


def twice(todo):
    return todo.where("t <> ''").select("id", F.explode(F.array("t", F.upper("t"))).alias("t"))


def test_kill_between_the_sinks(spark, tmp_path):
    """Nothing is lost or repeated, and while the batch is dead its rows are not to be seen."""
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    rows = [(i, "x" * (i % 4)) for i in range(40)] + [(5, "x")]
    stream = feed(spark, source, rows)

    def dies(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        W.two_sinks(stream, path, "id", twice, dies)
    held = W.Commits(spark, path)
    assert held.last() == 0 and (tmp_path / "out" / "rows" / "b=1").exists()
    seen = held.read("rows", "id long, t string")
    assert seen.where("b > 0").count() == 0
    marks = {r["id"] for r in held.read("done", "id long").collect()}
    assert {r["id"] for r in seen.collect()} == {i for i in marks if i % 4}
    W.two_sinks(feed(spark, source, []), path, "id", twice)
    got = sorted((r["id"], r["t"]) for r in held.read("rows", "id long, t string").collect())
    assert got == sorted((i, t) for i in range(40) if i % 4 for t in ("x" * (i % 4), "X" * (i % 4)))
    assert sorted(r["id"] for r in held.read("done", "id long").collect()) == list(range(40))
    W.two_sinks(feed(spark, source, [(7, "again"), (50, "new")], 1), path, "id", twice)
    assert held.read("rows", "id long, t string").count() == len(got) + 2 and held.read("done", "id long").count() == 41


def test_repeat_of_a_committed_batch(spark, tmp_path):
    held = W.Commits(spark, str(tmp_path / "out"))
    for n in range(5):
        held.commit(n)
    assert held.last() == 4 and len(list((tmp_path / "out" / "commits").glob("[0-9]*"))) == 2
    W.two_sinks(feed(spark, str(tmp_path / "in"), [(1, "a")], 1), str(tmp_path / "out"), "id", twice)  # batch 0 has its marker
    assert not (tmp_path / "out" / "rows").exists()


def test_marks_are_written_back(spark, tmp_path):
    path = str(tmp_path / "out")
    output = spark.createDataFrame([(1,), (1,), (3,), (None,)], "id long")
    assert sorted(r["id"] for r in W.marks_from_output(spark, path, "id", "bigint", output).collect()) == [1, 3]
    assert sorted(r["id"] for r in W.marks_from_output(spark, path, "id", "bigint", output.limit(0)).collect()) == [1, 3]
    held = W.two_sinks(feed(spark, str(tmp_path / "in"), [(1, "a"), (2, "b"), (3, "c"), (None, "d")], 1), path, "id", twice)
    assert sorted((r["id"] or 0) for r in held.read("rows", "id long, t string").collect()) == [0, 0, 2, 2]


def call(ns, ok, tokens):
    return json.dumps({"ns": ns, "ok": ok, "tokens": tokens})


def test_log_holds_back_torn_lines(spark, tmp_path):
    """Segments out of order, cut inside lines, one without a line end, damage: equal to the batch once all is there."""
    logs, path = tmp_path / "logs", str(tmp_path / "out")
    lines = [call(f"n{i % 3}", i % 2 == 0, i) for i in range(30)] + ["not json", "[1]", '{"ok": true}', ""] + [call("n0", True, 100)]
    text = "\n".join(lines) + "\n"
    torn = text.index("100")
    cuts = [0, 50, 55, 400, torn, len(text)]
    (logs / "a").mkdir(parents=True)
    (logs / "b").mkdir()
    (logs / "b" / "0.jsonl").write_text(call("n9", True, 1) + "\n" + call("n9", True, 2)[:-1])
    part = lambda n: (logs / "a" / f"{n:04d}.jsonl").write_text(text[cuts[n] : cuts[n + 1]])
    run = lambda: {r["ns"]: (r["n_calls"], r["n_ok"], r["tokens"]) for r in W.rolled(W.roll_up(W.log_segments(spark, str(logs)), path)).collect()}
    for n in (0, 2, 3):
        part(n)
    early = run()
    assert early["n9"] == (1, 1, 1) and sum(v[0] for v in early.values()) < 31
    part(1)
    run()
    want = {f"n{k}": (10, 5, sum(range(k, 30, 3))) for k in range(3)} | {"n9": (1, 1, 1)}
    assert run() == want  # the last line is still torn
    part(4)
    assert run() == want | {"n0": (11, 6, want["n0"][2] + 100)}
