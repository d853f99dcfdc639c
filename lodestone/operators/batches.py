"""Batch calls in chunks, asked again until all are answered or out of attempts.

Requests are numbered into chunks of bounded size, and a few chunks together are a wave: one Spark job, whose answers and chunk
states are written as one folder each under the wave's number. What a run has to ask is worked out from these tables alone, so a
driver that was killed goes on at the wave it was in, and a rerun asks nothing that has an answer or no attempts left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.catalog import query
from lodestone.plans.joins import scratch, stable
from lodestone.plans.tables import table
from lodestone.sources.files import chunked_ids
from lodestone.streaming.writers import Commits

Submit = Callable[[DataFrame], DataFrame]  # requests with `chunk` and `attempt` -> (id, body, error), some of them at the least
CHUNKS = "wave long, chunk long, attempt long, n long, n_ok long"


def _kind(requests: DataFrame, id_: str) -> str:
    return f"{id_} {requests.schema[id_].dataType.simpleString()}, body string, error string, attempt long, chunk long"


def answers(requests: DataFrame, id_: str, held: Commits) -> DataFrame:
    """(id, body, attempt): the first answer of every request that has one."""
    good = held.read("answers", _kind(requests, id_)).where("body IS NOT NULL")
    first = F.min_by(F.struct("body", "attempt"), F.struct("attempt", "body"))
    return good.groupBy(id_).agg(first.alias("a")).select(id_, "a.body", "a.attempt")


def chunk_states(held: Commits) -> DataFrame:
    """(wave, chunk, attempt, n, n_ok) of every chunk that was asked."""
    return held.read("chunks", CHUNKS).drop("b")


def open_requests(requests: DataFrame, id_: str, held: Commits, attempts: int) -> DataFrame:
    """(id, attempt): requests without an answer that were asked fewer than `attempts` times; attempt counts from 0."""
    asked = held.read("answers", _kind(requests, id_)).groupBy(id_).agg(F.count_if(F.col("body").isNotNull()).alias("ok"), (F.max("attempt") + 1).alias("attempt"))
    todo = requests.select(id_).where(F.col(id_).isNotNull()).distinct().join(asked, id_, "left")
    return todo.where("coalesce(ok, 0) = 0").select(id_, F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt")).where(F.col("attempt") < attempts)


def run_to_fixpoint(requests: DataFrame, id_: str, submit: Submit, path: str, attempts: int = 2, chunk: int = 10_000, wave: int = 64) -> Commits:
    """Ask `requests` (id and whatever else submit wants) until each has an answer or was asked `attempts` times.

    A request that submit gives no row for counts as asked, with the error `no answer`; of several rows for one
    the one with a body counts, the smallest if there are more. A submit that raises ends the run, and the wave it was
    in is asked again by the next one; waves before it are not. Requests with a null id are left out, repeats of an id
    are one request (the smallest row). An attempt ends before the next begins, so a request is asked once an attempt."""
    spark, held = requests.sparkSession, Commits(requests.sparkSession, path)
    others = [c for c in requests.columns if c != id_]
    one = requests.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.min(F.struct(*others)).alias("r")).select(id_, "r.*") if others else requests.select(id_).distinct()
    while True:
        todo = stable(open_requests(requests, id_, held, attempts))
        level = todo.agg(F.min("attempt").alias("a")).first()["a"]
        if level is None:
            return held
        todo = todo.where(F.col("attempt") == level)
        dealt = stable(chunked_ids(todo, id_, chunk))
        last = dealt.agg(F.max("chunk").alias("c")).first()["c"]
        for start in range(0, last + 1, wave):
            _wave(spark, one, id_, dealt.where(F.col("chunk").between(start, start + wave - 1)), level, submit, held)


def _wave(spark: SparkSession, one: DataFrame, id_: str, ids: DataFrame, attempt: int, submit: Submit, held: Commits) -> None:
    number = held.last() + 1
    asked = one.join(ids, id_).withColumn("attempt", F.lit(attempt).cast("long"))
    said = submit(asked).groupBy(id_).agg(F.min(F.struct(F.col("body").isNull().alias("none"), "body", "error")).alias("s"))
    rows = ids.join(said, id_, "left").select(id_, "s.body", F.when(F.col("s.body").isNull(), F.coalesce("s.error", F.lit("no answer"))).alias("error"), F.lit(attempt).cast("long").alias("attempt"), "chunk")
    held.write(rows, "answers", number)
    kept = spark.read.schema(_kind(one, id_)).parquet(f"{held.path}/answers/b={number}")  # submit is not asked a second time
    state = kept.groupBy("chunk", "attempt").agg(F.count("*").alias("n"), F.count_if(F.col("body").isNotNull()).alias("n_ok"))
    held.write(state.select(F.lit(number).cast("long").alias("wave"), "chunk", "attempt", "n", "n_ok"), "chunks", number)
    held.commit(number)


@query("batch_fixpoint", """WITH a AS (SELECT conv_id, min(turn) FILTER (length(text) % 3 <> 0) AS attempt FROM conversations WHERE turn < 3 GROUP BY conv_id)
SELECT i.conv_id AS conv_id, md5(min(c.text)) AS body, a.attempt::BIGINT AS attempt FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN a ON a.conv_id = i.conv_id LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.attempt AND length(c.text) % 3 <> 0 GROUP BY i.conv_id, a.attempt""")
def _fixpoint(spark, d):
    """Conversations as requests, a turn's text as the answer to an attempt of its number: an error if its length is a multiple of 3."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    fails = F.length("text") % 3 == 0
    recorded = c.select("conv_id", F.col("turn").cast("long").alias("attempt"), F.when(~fails, F.col("text")).alias("body"), F.when(fails, "HTTP 429").alias("error"))
    requests = c.select("conv_id").distinct()
    held = run_to_fixpoint(requests, "conv_id", lambda asked: asked.join(recorded, ["conv_id", "attempt"]).select("conv_id", "body", "error"), scratch(spark, "batches"), attempts=3, chunk=64, wave=1000)
    return requests.join(answers(requests, "conv_id", held), "conv_id", "left").select("conv_id", F.md5("body").alias("body"), "attempt")
