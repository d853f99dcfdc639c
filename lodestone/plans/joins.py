"""Joins that deal hot keys, prefix sums over a global order, and lineage cuts through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT = 256  # rows of one key that a task may meet, at the least
HOT_KEYS = 100_000  # keys that may be hot: a larger table needs more rows of a key to make it one


def spread_join(big: DataFrame, small: DataFrame, on: list[str], rows: int, n: str = "n", by: str | None = None, hot: int = HOT, hashed: bool = False, many: bool = False) -> DataFrame:
    """big joined with small (one row a key, with `n`, the rows that big has of it), hot keys dealt over many tasks.

    `rows` is the number of rows of big. A key is hot if it has more than max(hot, rows / HOT_KEYS) of them, so
    that at most HOT_KEYS keys are hot whatever the size of big: these alone are broadcast, to tell big's rows which
    of them take a salt (from column `by`, or at random places of the table). small's hot rows are repeated, one for
    each salt. `hashed` keeps wide rows of big from being sorted: a partition of small must then fit a task. `many` allows
    small several rows a key, all with the same `n`. `n` is dropped. Null keys match nothing."""
    most = max(hot, -(-rows // HOT_KEYS))
    salts = F.ceil(F.col(n) / F.lit(most)).cast("long")
    few = small.where(F.col(n) > most).select(*on, salts.alias("__salts"))
    few = (few.distinct() if many else few).limit(HOT_KEYS)  # the bound, for the planner too
    turn = F.xxhash64(by) if by else F.monotonically_increasing_id()
    salted = big.join(F.broadcast(few), on, "left").withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod(turn, F.col("__salts"))).otherwise(F.lit(0).cast("long"))).drop("__salts")
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1))).drop(n)
    return salted.join(dealt.hint("shuffle_hash") if hashed else dealt, [*on, "__salt"]).drop("__salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only in local mode may the setting be missing; a temporary folder is then set."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/lodestone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stable(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder: read as often as wanted, and not worked out again if an executor is lost."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files behind, instead of keeping them until a garbage collection."""
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside the block passes at most so many rows at once to Python: for rows of about a MB."""
    was = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, was)


def written(df: DataFrame, name: str = "table", large_rows: bool = False) -> DataFrame:
    """df as compressed columns in the shared folder, its shuffle files freed: for tables too large for `stable`.

    With `large_rows`, of about a MB each, a page is closed as soon as it is full, not after a hundred rows at the least."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with shuffles_freed(spark):
        (df.write.option("parquet.page.size.row.check.min", "1") if large_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, order: list[str], value: str | Column, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over all rows up to and with each, in the ascending order of columns `order`.

    A range-partitioned sort, one sum a partition, and prefix sums over those: the driver sees one number a
    partition, and no task sees more than its partition. Rows that tie in `order` must be alike or few."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(value) if isinstance(value, str) else value
    held = stable(df.withColumn("__value", value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sums = {r["__part"]: r["s"] or 0 for r in held.groupBy("__part").agg(F.sum("__value").alias("s")).collect()}  # a row a partition
    before, at = {}, 0
    for part in sorted(sums):
        before[part] = at
        at += sums[part]
    bases = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
    run = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn(name, F.sum("__value").over(run) + bases[F.col("__part")]).drop("__part", "__value")
