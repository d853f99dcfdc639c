"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded size, and every block keeps its rows sorted by each
dimension. A query walks down all lists at once (from the top where its component is positive, from the
bottom where it is negative), scores each row the first time it is seen, and stops when the threshold,
the score a row would have with the walk's present value in every list, cannot beat its kth result.
A query's results so far carry over to the next block of its group, so later blocks stop sooner.

Queries go to every block (a stated query set against all rows, in blocks): blocks of queries are
replicated by group of candidate blocks, and neither side is broadcast or collected. A group returns k rows
a query at most; a top-k within the task merges those of its groups before the shuffle, another one after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.shared import _to_arrow, cut, fan_out

BLOCK = 2048  # candidates of a block
QUERIES = 256  # queries of a block
GROUP = 16  # candidate blocks of a group at most: what a task holds; fewer where that leaves cores idle
HELD = 1 << 25  # bytes of a group's vectors and lists (16 a component) that a task holds
STEP = 32  # rows read from every list between two looks at the threshold


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, x): floor(scale * component) as integers, of the vectors whose components are all finite."""
    e = F.col(embedding)
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    x = F.transform(e, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, x).alias("x")).where("x IS NOT NULL")


def _blocks(size: int, kind: int):
    """Rows (g, vec_id, x) sorted by g -> (g, kind, ids, data, dims): a row a block of at most `size` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ids, rows, at = _to_arrow("g long, kind int, ids binary, data binary, dims int"), [], [], None

        def flush():
            dims = max(map(len, rows))
            data = np.zeros((len(rows), dims), "<i8")
            for i, r in enumerate(rows):
                data[i, : len(r)] = r
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((at, kind, np.array(ids, "<i8").tobytes(), data.tobytes(), dims), out, strict=True)], schema=out)

        for b in batches:
            for g, i, x in zip(b.column("g").to_pylist(), b.column("vec_id").to_pylist(), b.column("x").to_pylist(), strict=True):
                if rows and (g != at or len(rows) == size):
                    yield flush()
                    ids, rows = [], []
                at = g
                ids.append(i)
                rows.append(x)
        if rows:
            yield flush()

    return run


class Lists:
    """A block's rows sorted by every dimension, and the walk of one query."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.order = np.argsort(data, axis=0, kind="stable")  # ascending; read from its end for positive weights

    def top(self, query: np.ndarray, k: int, own: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id) of `best` and this block's rows other than `own`, by the threshold algorithm."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        if not len(used):  # every score is zero: the smallest ids win
            return sorted(best + [(0, int(i)) for i in np.sort(self.ids[self.ids != own])[:k]])[:k]
        falling, weights, seen, at = query[used] > 0, query[used], np.zeros(n, bool), 0
        while at < n and not seen.all():
            stop = min(n, at + STEP)
            walked = np.where(falling, self.order[::-1][at:stop, used], self.order[at:stop, used])
            hit = np.zeros(n, bool)
            hit[walked] = True
            new = np.flatnonzero(hit & ~seen)
            seen |= hit
            at = stop
            new = new[self.ids[new] != own]
            if len(new):
                score = self.data[new] @ query
                least = -best[-1][0] if len(best) >= k else np.partition(score, -k)[-k] if len(new) > k else None
                if least is not None:
                    keep = score >= least
                    new, score = new[keep], score[keep]
                best = sorted(best + list(zip((-score).tolist(), self.ids[new].tolist(), strict=True)))[:k]
            bound = int((self.data[walked[-1], used] * weights).sum())
            if len(best) >= k and bound < -best[-1][0]:  # a tie could still bring a smaller id
                break
        return best


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, kind, ids, data, dims) sorted by g and kind: candidate blocks (kind 0), then query blocks."""
        out = _to_arrow("query_id long, vec_id long, score long")
        at, lists = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["g"] != at:
                    at, lists = r["g"], []
                ids = np.frombuffer(r["ids"], "<i8")
                data = np.frombuffer(r["data"], "<i8").reshape(len(ids), r["dims"])
                if r["kind"] == 0:
                    lists.append(Lists(ids, data))
                    continue
                found = []
                for q, x in zip(ids.tolist(), data, strict=True):
                    best: list[tuple[int, int]] = []
                    for block in lists:
                        dims = block.data.shape[1]
                        query = np.zeros(dims, "<i8")
                        query[: min(dims, len(x))] = x[:dims]
                        best = block.top(query, k, q, best)
                    found += [(q, i, -s) for s, i in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)

    return run


def layout(dims: int) -> tuple[int, int, int]:
    """(candidates of a block, blocks of a group, queries of a block) for vectors of that length, within HELD bytes.

    A group holds at least one block of one vector: longer vectors make smaller blocks and more groups, not larger tasks."""
    rows = max(1, HELD // (16 * max(1, dims)))
    block = min(BLOCK, rows)
    return block, min(GROUP, max(1, rows // block)), max(1, min(QUERIES, HELD // (32 * max(1, dims))))


def search(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates other than its own id.

    Both sides are (vec_id, x) of integers; a task holds a number of bytes, whatever the length of vectors. Ties go to the smaller vec_id. Vectors of different lengths
    meet as if padded with zeros, however long; an empty one scores 0. A null vec_id or x takes no part. Candidates
    that repeat a row are separate results; a repeated query is one query. A query without candidates has no
    rows; empty tables give none. Other columns, whatever their names, are not read."""
    spark = candidates.sparkSession
    taken = lambda df: df.select("vec_id", "x").where("vec_id IS NOT NULL AND x IS NOT NULL")
    held = cut(taken(candidates), "vectors")
    n, dims = held.agg(F.count("*"), F.max(F.size("x"))).first()
    block, group, asking = layout(dims or 0)
    tasks = 4 * fan_out(spark)
    groups = max(1, min(-(-n // block), max(-(-n // (block * group)), tasks)))
    # places, not ids, are dealt: a repeated id cannot fill a group
    dealt = held.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    pack = "g long, kind int, ids binary, data binary, dims int"
    blocks = dealt.repartition(min(groups, tasks), "g").sortWithinPartitions("g").mapInArrow(_blocks(block, 0), pack)
    asked = taken(queries).dropDuplicates(["vec_id"]).withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(fan_out(spark))))
    asked = asked.repartition(fan_out(spark), "g").sortWithinPartitions("g").mapInArrow(_blocks(asking, 1), pack)
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = cut(blocks, "blocks").union(asked).repartition(min(groups, tasks), "g").sortWithinPartitions("g", "kind")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
