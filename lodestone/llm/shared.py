"""What the operators share: cutting lineage through the shared folder, Arrow maps, ranks, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.joins import HOT, spread_join

#: Words are what stands between these six ASCII characters (the same ones bytes.split() knows).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only in local mode, where driver and executors are one machine, may it be unset; a temporary folder
    is then made and set."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SCOPE: list[str] = []


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables cut inside the block go to one folder, which is yielded: remove() takes them all at once."""
    folder = scratch(spark, name)
    _SCOPE.append(folder)
    try:
        yield folder
    finally:
        _SCOPE.remove(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Tables stay there until their scope is removed, sweep() or the folder's own clean-up."""
    base = _SCOPE[-1] if _SCOPE else f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_name(spark: SparkSession, name: str = "") -> str:
    """A new name in the catalogue for a table whose files are in the shared folder (bucketed tables need one)."""
    base = "lodestone_" + re.sub(r"\W", "_", spark.sparkContext.applicationId.lower())
    return f"{base}_{name}_{uuid.uuid4().hex[:12]}" if name else base


def sweep(spark: SparkSession) -> None:
    """Delete everything this application has cut so far; call it once no DataFrame made here is needed."""
    for t in spark.catalog.listTables(pattern=f"{table_name(spark)}_*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    remove(spark, f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}")


def cut_to(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    return cut_to(df, name)[0]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _to_arrow(schema: str) -> pa.Schema:
    """'a long, b string' as an Arrow schema: the few types the operators exchange with Python."""
    return pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in schema.split(", "))])


def arrow_map(df: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """One call of fn(batch) -> {column: values} an Arrow batch; `schema` names the columns in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow(schema)
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fan_out(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit repartition: what the session holds right for a shuffle."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """df with `name`: the sum of `weight` (default: 1 a row) over all rows before it in `order`.

    A range-partitioned sort, a sum per partition, and prefix sums over those sums: the driver sees one
    number a partition, and no task sees more than its partition. The sort is cut, so that both passes
    see the same partitions even if an executor is lost between them."""
    spark = df.sparkSession
    n = fan_out(spark)
    held = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    w = F.col(weight) if weight else F.lit(1)
    sums = held.groupBy("__part").agg(F.sum(w).alias("s")).collect()  # a row a partition
    base, at = {}, 0
    for r in sorted(sums, key=lambda r: r["__part"]):
        base[r["__part"]] = at
        at += r["s"] or 0
    bases = F.create_map(*[F.lit(x) for kv in (base or {0: 0}).items() for x in kv])

    run = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn(name, (F.coalesce(F.sum(w).over(run), F.lit(0)) + F.coalesce(bases[F.col("__part")], F.lit(0))).cast("long")).drop("__part")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each is one grouped minimum (combined before the shuffle), written with
    the number of neighbours, and one join with it. Only where a node has more than HOT neighbours are they dealt over
    many tasks. Every round is cut, the one before it deleted. Ends when a round changes nothing."""
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = cut_to(now, "edges")

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def step(df: DataFrame, large: bool) -> tuple[DataFrame, str]:
        near = df.union(df.select("v", "u")) if large else df
        least, least_path = cut_to(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        if (least.agg(F.max("n")).first()[0] or 0) > HOT:
            both = spread_join(near, least, ["u"], 2 * most_edges, by="v")
        else:
            both = near.join(least.drop("n"), "u")
        if large:
            out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        else:
            out = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(both.select("u", F.col("m").alias("v"))).distinct()
        made = cut_to(out, "edges")
        remove(spark, least_path)
        return made

    seen = print_of(now)
    most_edges = seen[0]  # of the first round; later ones have no more than twice as many
    if seen[0]:
        for _ in range(most):
            half, half_path = step(now, True)
            after, next_path = step(half, False)
            was, seen = seen, print_of(after)
            remove(spark, path)
            remove(spark, half_path)
            now, path = after, next_path
            if was == seen:
                break
        else:
            raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def mix64(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser, elementwise."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Memo(dict):
    """key -> make(key), kept for up to `most` keys: words repeat, so few are made twice."""

    def __init__(self, make: Callable, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        made = self[key] = self.make(key)
        return made


def local_path(path: str) -> str | None:
    """A path on a mounted file system, or None if only Spark's readers can open it."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") and os.path.exists(path) else None
