"""Readers and writers on files made by hand, and what each does with damage."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import report_queries as R
from lodestone.plans import catalog, suite
from lodestone.plans.joins import running_sum, spread_join
from lodestone.sources import files as S

SF = "/root/testdata/sf0.001"
suite.load()


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n{"a": 3, "b": "é"}\n')
    assert [tuple(r) for r in S.read_jsonl(spark, str(path), "a long, b string").orderBy("a").collect()] == [(1, "x"), (2, None), (3, "é")]
    path.write_text('{"a": 1}\n{"a": 2, \n[3]\nnot json\n{"a": 4}\n')
    assert sorted(r["a"] for r in S.read_jsonl_tolerant(spark, str(path), "a long").collect() if r["a"] is not None) == [1, 4]
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_jsonl(spark, str(path), "a long").collect()


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "report.json")
    S.write_report(spark.createDataFrame([(1, "é")], "n long, s string"), path)
    assert S.read_json(path) == {"n": 1, "s": "é"} and "é" in (tmp_path / "report.json").read_text()
    assert S.read_json(str(tmp_path / "none.json")) is None
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "torn.json").write_text('{"a": ')
    assert S.read_json(str(tmp_path / "list.json")) is None and S.read_json(str(tmp_path / "torn.json")) is None


def test_qrels(spark, tmp_path):
    for heading in ("query-id\tcorpus-id\tscore\n", "Query-ID\tx\ty\n", ""):
        path = tmp_path / "qrels.tsv"
        path.write_text(heading + 'q1\td1\t1\nq1\td1\t1\nq2\t"d2\t1\nalone\nq3\td3\n')
        assert sorted(map(tuple, S.read_qrels(spark, str(path)).collect())) == [("q1", "d1"), ("q2", '"d2'), ("q3", "d3")]


def test_csv_columns(spark, tmp_path):
    path = str(tmp_path / "sheet")
    S.write_csv(spark.createDataFrame([(1, 'a "b", c\nd', None, "gone")], "id long, t string, u string, more string"), path, ["t", "u", "id", "fill"])
    rows = S.read_csv(spark, path)
    assert rows.columns == ["t", "u", "id", "fill"]
    assert [tuple(x or "" for x in r) for r in rows.collect()] == [('a "b", c\nd', "", "1", "")]


def test_config_and_version(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"llm": {"n": 2}, "cache_dir": "../c", "list": [1]}))
    got = S.read_config(str(tmp_path / "c.json"), {"llm": {"n": 1, "m": "x"}, "cache_dir": "cache", "artifacts_dir": "a", "list": [1, 2]})
    assert got == {"llm": {"n": 2, "m": "x"}, "cache_dir": str(tmp_path.parent / "c"), "artifacts_dir": str(tmp_path / "a"), "list": [1]}
    git = tmp_path / "tree" / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack-refs\nabc refs/heads/main\n")
    assert S.checked_out(str(tmp_path / "tree"))[1] == "abc"
    (git / "refs" / "heads" / "main").write_text("def\n")
    assert S.checked_out(str(tmp_path / "tree"))[1] == "def" and S.checked_out("p", "v1") == ("p", "v1")


def test_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", b"one"), ("in/b.bin", b"\x00" * 5000), ("MANIFEST.json", b"{}"), ("SHA256SUMS.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = S.manifest(spark, str(tmp_path))
    want = [("a.txt", 3, hashlib.sha256(b"one").hexdigest()), ("in/b.bin", 5000, hashlib.sha256(b"\x00" * 5000).hexdigest())]
    assert sorted(map(tuple, got.collect())) == want and S.sha256_of(str(tmp_path / "a.txt")) == want[0][2]
    assert [r[0] for r in got.orderBy("path").select(S.checksum_lines(got)).collect()] == [f"{h}  {p}" for p, _, h in want]
    made = catalog.QUERIES["release_manifest"](spark, SF)
    assert made.where("bytes > 0 AND length(sha256) = 64").count() == made.count() > 0


def test_versions_and_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.current_version(spark, path) is None
    for n in (1, 2, 3):
        S.replace_table(spark.range(n), path)
    assert S.current_version(spark, path).endswith("/v000003") and spark.read.parquet(f"{path}/v000001").count() == 1
    rows = spark.createDataFrame([("k", 1), ("k", 3), ("k", 2), ("j", 9)], "k string, o long")
    assert sorted(map(tuple, S.last_by(rows, "k", "o").collect())) == [("j", 9), ("k", 3)]
    assert S.prefix(spark.range(1, 10).withColumnRenamed("id", "rank"), 4).count() == 4


def test_running_sum(spark):
    data = [(i * 7 % 100, i % 5) for i in range(100)]
    got = {r["a"]: r["s"] for r in running_sum(spark.createDataFrame(data, "a long, v long"), ["a"], "v", "s").collect()}
    assert got == {a: sum(v for b, v in data if b <= a) for a, _ in data}
    assert running_sum(spark.createDataFrame([], "a long, v long"), ["a"], "v", "s").count() == 0


def test_spread_join(spark):
    big = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    small = big.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1").withColumn("w", F.col("k") * 2)
    assert sorted(map(tuple, spread_join(big, small, ["k"], 3000, hot=50).collect())) == sorted((k, v, 2 * k) for v in range(3000) if (k := 7 if v % 3 == 0 else v) % 2)


def test_latex_table(spark):
    rows = spark.createDataFrame([("a_b", 0.5), ("50%", None)], "name string, rate double")
    made = R.latex_table(rows, "Rates")
    assert "a\\_b & 0.500 \\\\" in made and "50\\% & -- \\\\" in made and made.endswith("\\end{table}")


def test_sources_on_edge_rows(spark):
    """No text, no unit, no document, no peers: a passage is then a source of its own and nothing more."""
    rows = [(1, "u", "d", ["a", "b"]), (2, "u", "d", ["x"]), (3, None, "d", ["a"]), (4, None, None, ["q"]), (5, None, None, None), (6, None, None, ["b", "z"])]
    got = {(r["id"], r["tier"]): r["partner"] for r in R.plan_sources(spark.createDataFrame(rows, "id long, unit string, doc string, s array<string>"), rate=1.0).collect()}
    assert {i for i, t in got if t == "single"} == {1, 2, 3, 4, 5, 6}
    assert got[(1, "unit")] == 2 and got[(2, "unit")] == 1 and got[(3, "doc")] == 1 and got[(6, "all")] == 1
    assert not any(i in (4, 5) and t != "single" for i, t in got)
