"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition sorts its documents by a short fingerprint, writes them under its number (`chunk`), and sends each
   owner of a range of fingerprints one message: the sorted distinct fingerprints of that range as Golomb-coded
   gaps, and a bitmap of those it has more than once.
2. An owner decodes its messages, finds what came more than once, and answers each with a bitmap.
3. The bitmaps of a chunk go back to its documents, which never moved (the table is bucketed by chunk, so the join
   shuffles only bitmaps). Documents whose bit is not set are unique. The others are suspects: their texts are
   grouped by the text itself, byte for byte, copies in one task being combined before the shuffle.

A fingerprint has so many bits that a unique document is a suspect once in 256 times; that costs a shuffle of its text,
never a wrong result. Owners hold about OWNER_ROWS fingerprints; their number follows the number of rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, cut, fan_out, scratch, spread_join, table_name

OWNER_ROWS = 1 << 23
SPARE = 8  # bits of a fingerprint beyond those that number the rows: a unique one is a suspect once in 2 ** SPARE


def normalised(text):
    """A text with A-Z, and nothing else, lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def golomb(values: np.ndarray, low: int) -> bytes:
    """Ascending distinct numbers of at least `low` as Golomb-coded gaps whose divisor is a power of two.

    One byte holds the power; quotients follow in unary, each ended by a one, then all remainders."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(low))
    mean = float(gaps.mean()) if len(gaps) else 0.0
    power = max(0, round(math.log2(mean * math.log(2)))) if mean > 2 else 0
    quotient = (gaps >> np.uint64(power)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(power, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
    return bytes([power]) + np.packbits(np.concatenate([unary, rest])).tobytes()


def ungolomb(coded: bytes, n: int, low: int) -> np.ndarray:
    """The n numbers of golomb()."""
    power, bits = coded[0], np.unpackbits(np.frombuffer(coded, np.uint8, offset=1))
    ends = np.flatnonzero(bits)[:n]  # the first n ones end the quotients
    quotient = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1 if n else 0
    rest = bits[start : start + n * power].reshape(n, power).astype(np.uint64)
    remainder = (rest << np.arange(power, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(power)) + remainder, dtype=np.uint64) + np.uint64(low)


def owner_low(owner: int, owners: int, bits: int) -> int:
    """The first fingerprint of an owner's range."""
    return -(-(owner << bits) // owners)


SENT = "kind int, chunk int, bit long, row long, doc_id long, sha string, text string, owner int, n int, coded binary, again binary"


def _send(batches: Iterator[pa.RecordBatch], owners: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows sorted by fp -> the same rows (kind 0) with the place of their bit, and its messages (kind 1).

    Bits of a message start on a whole byte, those of the next owner after them."""
    out = _to_arrow(SENT)
    owner, base, found, again = -1, 0, [], []  # of the message that is being made

    def message(chunk: int):
        values = np.array(found, np.uint64)
        row = (1, chunk, *[None] * 5, owner, len(found), golomb(values, owner_low(owner, owners, bits)), np.packbits(np.array(again, np.uint8)).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

    chunk, row = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk")[0].as_py()
        places = []
        for fp in batch.column("fp").to_pylist():
            if found and fp == found[-1]:
                again[-1] = 1
            else:
                to = fp * owners >> bits
                if to != owner:
                    if found:
                        yield message(chunk)
                    base += -(-len(found) // 8) * 8
                    owner, found, again = to, [], []
                found.append(fp)
                again.append(0)
            places.append(base + len(found) - 1)
        n = batch.num_rows
        none = lambda f: pa.nulls(n, out.field(f).type)
        number = pa.array(np.arange(row, row + n) + (chunk << 33), pa.int64())
        row += n
        rows = [pa.array(np.zeros(n, np.int32)), batch.column("chunk"), pa.array(places, pa.int64()), number, *(batch.column(c) for c in ("doc_id", "sha", "text")), *map(none, ("owner", "n", "coded", "again"))]
        yield pa.RecordBatch.from_arrays(rows, schema=out)
    if found:
        yield message(chunk)


def _answer(batches: Iterator[pa.RecordBatch], owners: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Messages sorted by owner -> (chunk, owner, bits): which of a message's fingerprints came more than once in all."""
    out = _to_arrow("chunk int, owner int, bits binary")

    def flush(owner: int, held: list):
        values = [ungolomb(coded, n, owner_low(owner, owners, bits)) for _, n, coded, _ in held]
        every, count = np.unique(np.concatenate(values), return_counts=True)
        twice = every[count > 1]
        flags = []
        for v, (_, n, _, again) in zip(values, held, strict=True):
            at = np.searchsorted(twice, v)
            seen = twice[np.minimum(at, len(twice) - 1)] == v if len(twice) else np.zeros(n, bool)
            flags.append(np.packbits(seen | np.unpackbits(np.frombuffer(again, np.uint8))[:n].astype(bool)).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int32()), pa.array([owner] * len(held), pa.int32()), pa.array(flags, pa.binary())], schema=out)

    now, held = None, []
    for batch in batches:
        for chunk, owner, n, coded, again in zip(*(batch.column(c).to_pylist() for c in ("chunk", "owner", "n", "coded", "again")), strict=True):
            if owner != now and held:
                yield flush(now, held)
                held = []
            now = owner
            held.append((chunk, n, coded, again))
    if held:
        yield flush(now, held)


def _bucketed(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder, by kind and in buckets of chunks: a join on chunk then leaves them where they are."""
    spark = rows.sparkSession
    table = table_name(spark, name)
    rows.write.partitionBy("kind").bucketBy(fan_out(spark), "chunk").option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)


def exchange(docs: DataFrame, n: int, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(row, doc_id, sha, text, suspect) of the n rows (doc_id, text): a number a row, its text normalised, and whether
    other rows share its fingerprint."""
    spark = docs.sparkSession
    owners = max(1, -(-n // owner_rows), min(fan_out(spark), n // 1024))
    bits = min(62, max(8, n.bit_length() + SPARE))
    marked = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("sha", F.sha2("text", 256))
    marked = marked.withColumn("fp", F.shiftrightunsigned(F.xxhash64("text"), 64 - bits)).withColumn("chunk", F.spark_partition_id())
    sent = _bucketed(marked.sortWithinPartitions("fp").mapInArrow(partial(_send, owners=owners, bits=bits), SENT), "exact")

    asked = sent.where("kind = 1").select("chunk", "owner", "n", "coded", "again").repartition(fan_out(spark), "owner").sortWithinPartitions("owner")
    answers = cut(asked.mapInArrow(partial(_answer, owners=owners, bits=bits), "chunk int, owner int, bits binary"), "answers")
    # a chunk's bitmaps in the order of their owners are one bitmap: as many bits as the chunk has fingerprints
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("owner", F.hex("bits").alias("hex")))), lambda x: x.getField("hex"))
    replies = answers.groupBy("chunk").agg(F.unhex(F.array_join(in_order, "")).alias("bits"))

    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS int) + 1, 1)")), 16, 10).cast("int")
    suspect = byte.bitwiseAND(F.expr("shiftleft(1, CAST(7 - bit % 8 AS int))")) != 0
    rows = sent.where("kind = 0").select("chunk", "bit", "row", "doc_id", "sha", "text")
    return rows.join(replies.hint("shuffle_hash"), "chunk").select("row", "doc_id", "sha", "text", suspect.alias("suspect"))


def same_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row a row of docs.

    Texts are equal if they are the same bytes once A-Z are lower-cased; of equal texts the row with the largest doc_id
    is kept, and keep_id is its doc_id. A null text is an empty one; a very long one is one value, compared whole.
    Of rows that repeat the largest doc_id, one is kept. A null doc_id is smaller than all others, and kept only
    if its group has no other. An empty table gives no rows. Other columns, whatever their names, are not read.

    Rows are grouped by text, not by hash; a group is named by the SHA-256 of its text, by which its rows find it."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = read.count()  # of Parquet, footers only
    rows = exchange(read, n, owner_rows)
    top = F.max(F.struct("doc_id", "row"))  # nulls are smallest
    groups = cut(rows.where("suspect").groupBy("sha", "text").agg(top.alias("top"), F.count("*").alias("n")).select("sha", "top", F.col("n").alias("group_size"), "n"), "groups")
    few = rows.select("row", "doc_id", "sha", "suspect")
    alone = few.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    copies = spread_join(few.where("suspect"), groups, ["sha"], n, by="row")
    return alone.union(copies.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("top.row") == F.col("row")).alias("kept"), "sha"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256 FROM t
"""
