"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id; each partition writes, in one pass, a token file (the
ids of its documents, little-endian, nothing between or before them), an offset file (for each document
the ids before it in the partition, as unsigned 64-bit integers) and a file of doc_ids. All three can be
memory-mapped. Partition bases, the ids before a partition's first, come from prefix sums over the
partitions' token counts.

A task names its files by a fresh id and returns one manifest row, so files of lost or repeated attempts
are never read: the manifest, a Parquet table written by Spark, is what commits them. Files go to any
store that Arrow's file systems open; mounted ones are mapped, of others a block of documents is read at a time.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, fan_out, local_path, scratch, utf8
from lodestone.llm.tokens import encoder, public_path

END = 2
MANIFEST = "part int, name string, n_docs long, n_tokens long"
_ORDER = np.dtype([("null", "?"), ("doc_id", "<i8")])


# fixed values: schemes that Spark and Arrow name differently
SCHEMES = {"s3a": "s3", "s3n": "s3"}
BLOCK = 10_000  # documents read at a time


def arrow_uri(path: str) -> str:
    """A path as Arrow's file systems name it (file, hdfs, s3, gs, abfss); others fail there with Arrow's own error."""
    scheme, colon, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if colon else path


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without is on Hadoop's default file system, as for Spark, not on a task's own disk."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    made = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file:///" + made[5:].lstrip("/") if made.startswith("file:") else made


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(arrow_uri(path)) if ":" in path else (fs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END, drops_space: bool = False, dtype: str = "<u2") -> str:
    """Write docs (doc_id, text) under path and return it as a URI; without a scheme it is on Hadoop's default file system.

    A null or empty text is a document of the end id alone; a text of any length is one document. Null doc_ids
    come first; rows that repeat a doc_id follow each other in the order of a hash of their text. An empty
    table makes an empty manifest. Other columns of docs, whatever their names, are not read."""
    spark, end = docs.sparkSession, np.array([end_id], dtype).tobytes()
    path = qualified(spark, path)
    if end_id > np.iinfo(dtype).max:
        raise ValueError(f"end id {end_id} does not fit {dtype}")
    width = np.dtype(dtype).itemsize
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.repartitionByRange(fan_out(spark), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, name, at, n = encoder(tokenizer, drops_space, dtype), uuid.uuid4().hex, 0, 0
        files: list = []
        for b in batches:
            if b.num_rows and not files:
                store, base = _store(path)
                store.create_dir(base)
                files = [store.open_output_stream(f"{base}/{name}.{kind}") for kind in ("tokens", "offsets", "ids")]
            starts = []
            for ids in own.encode(utf8(b)):
                files[0].write(ids + end)
                starts.append(at)
                at += len(ids) // width + 1
            if starts:
                files[1].write(np.array(starts, "<u8").tobytes())
                ids = np.zeros(b.num_rows, _ORDER)
                ids["null"] = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids["doc_id"] = b.column("doc_id").fill_null(0).to_numpy()
                files[2].write(ids.tobytes())
                n += len(starts)
        for f in files:
            f.close()
        if files:
            row = (TaskContext.get().partitionId(), name, n, at)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _to_arrow(MANIFEST), strict=True)], schema=_to_arrow(MANIFEST))

    rows.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return path


class Flat:
    """A file of equal items: mapped where it is mounted, else read by ranges."""

    def __init__(self, path: str, dtype):
        self.dtype, mounted = np.dtype(dtype), local_path(path)
        self.mapped = None if mounted is None else np.memmap(mounted, self.dtype, "r")
        if mounted is None:
            store, name = _store(path)
            self.file = store.open_input_file(name)

    def items(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(size * (stop - start), size * start), self.dtype)


def read_tokens(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    path = qualified(spark, path)
    parts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect()  # a row a partition
    based, base = [], 0
    for p in parts:
        based.append((p["name"], p["n_docs"], p["n_tokens"], base))
        base += p["n_tokens"]
    todo = spark.createDataFrame(based, "name string, n_docs long, n_tokens long, base long").repartition(max(1, len(based)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow("doc_id long, start long, n_tokens long, ids_crc32 long")
        for b in batches:
            for r in b.to_pylist():
                tokens, offsets, ids = (Flat(f"{path}/{r['name']}.{kind}", t) for kind, t in (("tokens", dtype), ("offsets", "<u8"), ("ids", _ORDER)))
                for i in range(0, r["n_docs"], BLOCK):
                    stop = min(r["n_docs"], i + BLOCK)
                    edge = offsets.items(i, min(r["n_docs"], stop + 1)).astype(np.int64)
                    edge = edge if stop < r["n_docs"] else np.append(edge, r["n_tokens"])
                    own, data = ids.items(i, stop), tokens.items(edge[0], edge[-1])
                    crc = [zlib.crc32(data[s:e].astype("<u4").tobytes()) for s, e in zip(edge[:-1] - edge[0], edge[1:] - edge[0], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own["doc_id"], pa.int64(), mask=own["null"]), pa.array(edge[:-1] + r["base"]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], schema=out)

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, scratch(spark, "tokens"), public_path("byte_bpe_50k.json")))
