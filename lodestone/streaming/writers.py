"""Micro-batches that commit rows and done marks together, and a call log that is rolled up while it is written.

A batch writes its tables under its own number and then one marker. Numbers are handed out one after another and a batch that
failed is run again under its number, so all batches up to the last marker are whole: a reader takes `b <= last`, which prunes
folders, and never sees the tables of a batch that died between two sinks. A repeat overwrites its own folders; one that
had its marker already is skipped, so that what was read once stays as it was.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.catalog import query
from lodestone.plans.joins import scratch
from lodestone.plans.tables import table


class Commits:
    """The markers of a folder: one empty file a batch, of which the last two are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def last(self) -> int:
        """The number of the last committed batch; -1 if there is none."""
        return max(self._numbers(), default=-1)

    def commit(self, batch: int) -> None:
        self._fs.create(self._path(f"{self.path}/commits/{batch}"), True).close()
        for old in self._numbers()[:-2]:
            self._fs.delete(self._path(f"{self.path}/commits/{old}"), False)

    def read(self, name: str, schema: str) -> DataFrame:
        """A table of all committed batches, with `b`; empty if nothing was committed."""
        there = self._fs.exists(self._path(f"{self.path}/{name}"))
        rows = self.spark.read.schema(f"{schema}, b long").parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], f"{schema}, b long")
        return rows.where(F.col("b") <= self.last())

    def write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/b={batch}")


def run_stream(stream: DataFrame, path: str, each: Callable[[DataFrame, int, Commits], None]) -> Commits:
    """All that is there now through `each`, batch by batch, each committed once. The stream's place is kept under path."""
    held = Commits(stream.sparkSession, path)

    def batch(rows: DataFrame, number: int) -> None:
        if number > held.last():
            each(rows, number, held)
            held.commit(number)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start().awaitTermination()
    return held


def two_sinks(sources: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], after_rows: Callable[[int], None] = lambda _: None) -> Commits:
    """Run `work` over a stream of sources: its rows go to table `rows`, the sources' keys to table `done`.

    A source counts once: repeats in a batch are one, and one that is marked is not worked on again. A source that gives
    no rows is marked like any other; one with a null key is worked on and not marked. Of the marks only those that a
    batch asks about are joined. `after_rows` is called between the two sinks."""
    kind = f"{key} {sources.schema[key].dataType.simpleString()}"

    def each(rows: DataFrame, number: int, held: Commits) -> None:
        keyed = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
        seen = held.read("done", kind).select(key).join(rows.select(key).distinct(), key, "left_semi")
        todo = keyed.join(seen, key, "left_anti")
        held.write(work(todo), "rows", number)
        after_rows(number)
        held.write(todo.where(F.col(key).isNotNull()).select(key), "done", number)

    return run_stream(sources, path, each)


def marks_from_output(spark: SparkSession, path: str, key: str, kind: str, output: DataFrame) -> DataFrame:
    """The done marks under path; where there are none, those that the output shows, which are written back once.

    They stand under the number -1, before all batches, so that a stream that starts later passes their sources over."""
    held = Commits(spark, path)
    marks = held.read("done", f"{key} {kind}")
    if marks.isEmpty():
        held.write(output.where(F.col(key).isNotNull()).select(F.col(key).cast(kind)).distinct(), "done", -1)
        marks = held.read("done", f"{key} {kind}")
    return marks.select(key)


@query("stream_two_sinks", r"SELECT doc_id, len(string_split_regex(trim(text), '\s+'))::BIGINT AS n_words FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, -1 FROM documents")
def _two_sinks(spark: SparkSession, d: str):
    """Rows and marks (n_words -1) of a resumed run: the output of a third of the documents was there, without marks."""
    docs, feed, path = table(spark, d, "documents").select("doc_id", "text"), scratch(spark, "sources"), scratch(spark, "sinks")
    docs.repartition(8, "doc_id").write.parquet(feed)
    marks_from_output(spark, path, "doc_id", "bigint", docs.where("doc_id % 3 = 0"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 3).parquet(feed)
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("long")
    held = two_sinks(stream, path, "doc_id", lambda todo: todo.where("trim(coalesce(text, '')) <> ''").select("doc_id", words.alias("n_words")))
    done = held.read("done", "doc_id long").select("doc_id", F.lit(-1).cast("long").alias("n_words"))
    return held.read("rows", "doc_id long, n_words long").drop("b").union(done)


# ---- a call log -------------------------------------------------------------------------------------------------------------

SEGMENT = "log string, seg long, text string"
CALL = "ns string, ok boolean, tokens long"
PIECE = "log string, seg long, kind string, head string, tail string"
ROLLUP = "ns string, n_calls long, n_ok long, tokens long"


def log_segments(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (log, seg, text): the files <path>/<log>/<number>.jsonl, whole. A log's writer starts its next
    file, wherever a line stands, once one is closed; files come in any order and must fit a task's memory."""
    files = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.element_at(parts, -2).alias("log"), F.regexp_extract(F.element_at(parts, -1), r"^(\d+)", 1).cast("long").alias("seg"), F.col("value").alias("text"))


def _stitch(frame: pd.DataFrame) -> pd.DataFrame:
    """One log's open pieces: lines that are whole now, the log's place (kind `at`: the next segment, and the torn line
    before it), and pieces whose forerunner is not there yet. A log's first segment has the number 0."""
    place = frame[frame["kind"] == "at"]
    nxt, torn = (int(place["seg"].iloc[0]), [place["tail"].iloc[0]]) if len(place) else (0, [""])
    out, log = [], frame["log"].iloc[0]
    rest = frame[frame["kind"] != "at"].sort_values("seg")
    for seg, kind, head, tail in zip(rest["seg"], rest["kind"], rest["head"], rest["tail"], strict=True):
        if seg != nxt:
            if seg > nxt:
                out.append((log, seg, kind, head, tail))
            continue
        nxt += 1
        torn.append(head)
        if kind == "cut":
            out.append((log, seg, "line", "".join(torn), None))
            torn = [tail]
    return pd.DataFrame([*out, (log, nxt, "at", None, "".join(torn))], columns=["log", "seg", "kind", "head", "tail"])


def roll_up(segments: DataFrame, path: str) -> Commits:
    """Calls, successes and tokens a namespace, batch by batch (table `parts`), of a stream of (log, seg, text).

    Lines inside a segment are read where they are. A segment's first and last pieces go to table `open`, a version a batch:
    the last piece is held back until the segment that ends it is there. Only pieces are grouped by log, never texts. A line that
    is no JSON object or has no namespace is left out; a log's unended last line stays held back."""

    def each(rows: DataFrame, number: int, held: Commits) -> None:
        cut = rows.where("text IS NOT NULL").select("log", "seg", F.split("text", "\n").alias("l"))
        solid = F.size("l") == 1
        pieces = cut.select("log", "seg", F.when(solid, "solid").otherwise("cut").alias("kind"), F.element_at("l", 1).alias("head"), F.when(~solid, F.element_at("l", -1)).alias("tail"))
        before = held.read("open", PIECE).where(F.col("b") == number - 1).drop("b")
        held.write(before.unionByName(pieces).groupBy("log").applyInPandas(_stitch, PIECE), "open", number)
        now = held.spark.read.schema(PIECE).parquet(f"{held.path}/open/b={number}").where("kind = 'line'").select(F.col("head").alias("line"))
        inner = cut.where(F.size("l") > 2).select(F.explode(F.expr("slice(l, 2, size(l) - 2)")).alias("line"))
        call = inner.union(now).select(F.from_json("line", CALL).alias("c")).where("c.ns IS NOT NULL")
        sums = [F.count("*").alias("n_calls"), F.count_if(F.col("c.ok")).alias("n_ok"), F.sum(F.coalesce("c.tokens", F.lit(0))).alias("tokens")]
        held.write(call.groupBy(F.col("c.ns").alias("ns")).agg(*sums), "parts", number)

    return run_stream(segments, path, each)


def rolled(held: Commits) -> DataFrame:
    """(ns, n_calls, n_ok, tokens) over all committed batches."""
    return held.read("parts", ROLLUP).groupBy("ns").agg(*[F.sum(c).alias(c) for c in ("n_calls", "n_ok", "tokens")])


LINES = 500  # of a log in the query below


@query("stream_call_log", "SELECT event_type AS ns, count(*) AS n_calls, count(*) FILTER (value > 50) AS n_ok, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS tokens FROM events GROUP BY 1")
def _call_log(spark: SparkSession, d: str):
    """Events as logs of LINES lines, each cut into three segments wherever the cut falls; the last line of each is ended."""
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("ns"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("ok"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens")))
    logs = e.groupBy(F.floor(F.col("event_id") / LINES).cast("string").alias("log")).agg(F.concat(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).getField("l"), "\n"), F.lit("\n")).alias("text"))
    size = F.floor(F.length("text") / 3).cast("int")
    piece = F.when(F.col("seg") < 2, F.substring("text", F.col("seg").cast("int") * size + 1, size)).otherwise(F.substring("text", 2 * size + 1, F.length("text")))
    feed, path = scratch(spark, "segments"), scratch(spark, "rollup")
    logs.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).select("log", "seg", piece.alias("text")).repartition(8, "seg", "log").write.parquet(feed)
    return rolled(roll_up(spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 3).parquet(feed), path))
