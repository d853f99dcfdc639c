"""Compressed vector codes: a codebook a part, fitted and searched with annular norm pruning.

A vector is cut into equal parts, and each part is replaced by the number of the nearest entry of its part's
codebook. The nearest entry is found by norms: entries are sorted by theirs, the search starts at the entry whose
norm is closest to the part's, and since |x - c| >= ||x| - |c||, no entry outside the annulus [|x| - d, |x| + d]
can be as near as the best distance d so far. The annulus is found by binary search, shrinks as d does, and its
entries are weighed exactly, both ends included, so that ties are seen and go to the lower index.

Codebooks are of a fixed size (entries x dimensions): a round sends them to every task and brings back one sum a
component and entry, added up within a task and then by Spark. Vectors are written once, as packed integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, cut, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
EDGE = 1 << 27  # larger scaled components are held to it, so that the squares of 127 dimensions a part fit 64 bits


class Annuli:
    """The entries of one codebook sorted by norm, with the search for the nearest."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        norm = np.sqrt((self.entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]
        self.weighed = 0  # exact distances worked out so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row of x, ties to the lower index."""
        n, k = len(x), len(self.order)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        after = np.clip(np.searchsorted(self.norm, norm), 0, k - 1)
        before = np.maximum(after - 1, 0)
        first = np.where(norm - self.norm[before] <= np.abs(self.norm[after] - norm), before, after)
        best = np.full(n, np.iinfo(np.int64).max)
        index = np.full(n, k)
        low, high = np.zeros(n, np.int64), np.full(n, k)

        def weigh(rows: np.ndarray, places: np.ndarray) -> None:
            found = self.order[places]
            gap = x[rows] - self.entries[found]
            d = np.einsum("ij,ij->i", gap, gap)
            self.weighed += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (found < index[rows]))
            hit = rows[better]
            best[hit], index[hit] = d[better], found[better]
            radius = np.sqrt(best[hit].astype(np.float64))
            slack = 1e-9 * (radius + norm[hit]) + 1e-6  # rounding may widen the annulus, never narrow it
            low[hit] = np.searchsorted(self.norm, norm[hit] - radius - slack, "left")
            high[hit] = np.searchsorted(self.norm, norm[hit] + radius + slack, "right")

        weigh(np.arange(n), first)
        for step in range(1, k):  # outwards on both sides, as long as the place is inside the annulus of now
            for places in (first - step, first + step):
                rows = np.flatnonzero((places >= low) & (places < high))
                if len(rows):
                    weigh(rows, places[rows])
        return index, best


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): floor(scale * component) as integers, of the vectors whose components are all finite."""
    e = F.col(embedding)
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # held to the edge before the floor, which would not fit a long otherwise
    held = lambda v: F.least(F.greatest(F.lit(float(scale)) * v.cast("double"), F.lit(-float(EDGE))), F.lit(float(EDGE)))
    x = F.transform(e, lambda v: F.floor(held(v)).cast("long"))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.when(fine, x).alias("x")).where("x IS NOT NULL")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A column of lists as a matrix, short rows padded with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(ends)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims).astype(np.int64)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (x) -> (part, entry, place, total, n): the sums of the parts that fall to each entry, once a task."""
    out, width = _to_arrow(SUMS), books[0].shape[1]
    searches = [Annuli(b) for b in books]
    total = np.zeros((len(books), len(books[0]), width), np.int64)
    count = np.zeros((len(books), len(books[0])), np.int64)
    for batch in batches:
        x = _matrix(batch.column("x"), len(books) * width)
        for p, search in enumerate(searches):
            own = x[:, p * width : (p + 1) * width]
            index, _ = search.nearest(own)
            order = np.argsort(index, kind="stable")
            entries, start, often = np.unique(index[order], return_index=True, return_counts=True)
            total[p, entries] += np.add.reduceat(own[order], start)
            count[p, entries] += often
    part, entry, place = (a.ravel() for a in np.indices(total.shape))
    often = np.repeat(count.ravel(), width)
    columns = (part, entry, place, total.ravel(), often)
    yield pa.RecordBatch.from_arrays([pa.array(c[often > 0], f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, x) -> the same rows with code and error."""
    width = books[0].shape[1]
    searches = [Annuli(b) for b in books]
    for batch in batches:
        x = _matrix(batch.column("x"), len(books) * width)
        found = [s.nearest(x[:, p * width : (p + 1) * width]) for p, s in enumerate(searches)]
        code = np.stack([i for i, _ in found], 1).astype(np.uint8 if len(books[0]) <= 256 else ">u2")
        made = [pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(np.sum([d for _, d in found], 0), pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), *made], names=["vec_id", "label", "x", "code", "error"])


SUMS = "part long, entry long, place long, total long, n long"


def seeds(held: DataFrame, parts: int, entries: int, width: int) -> list[np.ndarray]:
    """The first codebooks: the vectors of the smallest distinct ids (of rows that repeat an id the least vector)."""
    first = held.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries).collect()
    rows = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        rows[i, : len(r["x"])] = r["x"]
    return [rows[:, p * width : (p + 1) * width] for p in range(parts)]


def fit(held: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of (vec_id, x) after `rounds` rounds of nearest entries and floored means; unused entries stay."""
    dims = held.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-dims // parts))
    books = seeds(held, parts, entries, width)
    if not len(books[0]):
        return books
    for _ in range(rounds):
        sums = held.select("x").mapInArrow(partial(_sums, books=books), SUMS)
        # decimals: no number of rows overflows; as many rows come back as the codebooks have components
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, x, code, error), codebooks) of integer vectors (vec_id, label, x).

    Vectors of different lengths are read as if padded with zeros to the longest, and to a multiple of `parts`; an
    empty one is all zeros. A null x takes no part. Rows that repeat are coded each; of rows that repeat an id, the
    least vector can be a seed. A null vec_id is coded but is no seed; if every id is null nothing can be coded
    and there are no rows. Fewer ids than `entries` make smaller codebooks; an empty table gives no rows. Other
    columns, whatever their names, are not read."""
    held = cut(vectors.where("x IS NOT NULL").select("vec_id", "label", "x"), "vectors")
    books = fit(held, parts, entries, rounds)
    if not len(books[0]):
        return held.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    kind = held.schema["label"].dataType.simpleString()
    return held.mapInArrow(partial(_codes, books=books), f"vec_id long, label {kind}, x array<long>, code string, error long"), books


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integer vector that a code stands for."""
    step = 2 if len(books[0]) <= 256 else 4
    return np.concatenate([b[int(code[p * step : p * step + step], 16)] for p, b in enumerate(books)])


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Coded rows with label_error: the error summed over all rows of a label, nulls together.

    Errors are added up before the shuffle, and the rows of a frequent label are dealt over many tasks."""
    key = F.struct(F.col("label").isNull().alias("none"), F.col("label").cast("string").alias("name"))
    keyed = cut(coded.select("vec_id", F.to_json(key).alias("key"), "code", "error"), "coded")
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return spread_join(keyed, sums, ["key"], keyed.count(), by="vec_id").drop("key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(i: int, last: bool = False) -> str:
    """SQL of one round: d{i} the nearest entry of every part, c{i + 1} the codebooks after it."""
    made = f"""
n{i} AS MATERIALIZED (SELECT row, part, min((d, entry)) AS m FROM (SELECT row, v.part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM v JOIN c{i} USING (part, place) GROUP BY ALL) GROUP BY ALL)"""
    if last:
        return made
    return (
        made
        + f""",
c{i + 1} AS MATERIALIZED (SELECT part, place, entry, coalesce(g.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT part, place, m[2] AS entry, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM v JOIN n{i} USING (row, part) GROUP BY ALL) g USING (part, place, entry))"""
    )


OP11_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT ceil(max(len(e)) / 8)::BIGINT AS width FROM k),
v AS MATERIALIZED (SELECT row, vec_id, (i - 1) // width AS part, (i - 1) % width AS place, x FROM (SELECT row, vec_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM k), w),
s AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (SELECT part, place, entry, x AS c FROM v JOIN s USING (row)),{",".join(_round(i) for i in range(ROUNDS))},{_round(ROUNDS, True)},
q AS (SELECT row, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM n{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM q JOIN k USING (row), h
"""
