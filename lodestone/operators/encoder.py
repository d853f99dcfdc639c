"""A text encoder learned from a corpus: the leading right singular vectors of its TF-IDF matrix.

Subspace iteration. Texts are packed once into blocks of BLOCK_CHARS characters or so: the counts of a block's texts as compressed arrays over
the block's own word numbers. Tokens are dealt into parts, and a part's vectors are one matrix. In a round every part
sends each block the vectors of the tokens it has, a block sums them into its texts and those back into its tokens, and every
part adds up what comes back, SLICE dimensions at a time. So what travels grows with the tokens of blocks, not with the
words of texts. Between rounds the basis is made orthonormal by its Gram matrix, dims by dims numbers that are summed part
by part: the only thing that the driver sees. No task holds more than a block and the vectors of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.llm.shared import mix64, remove
from lodestone.plans.catalog import query
from lodestone.plans.joins import arrow_batches, scratch, shuffles_freed, written
from lodestone.plans.tables import table

DIMS, ROUNDS = 64, 3
RANK = 1e-9  # directions below this share of the strongest are not there
BLOCK_CHARS, BLOCK_WORDS, LEAST_BLOCKS = 64_000_000, 8_000_000, 6  # characters of a block, about; its pairs of a text and a token at most; blocks at least
SLICE = 16  # dimensions that travel at once
TEXTS, TOKENS = 1000, 20_000  # texts, and tokens, of one row of a block; tokens of a part, at least


def _bytes(*arrays: np.ndarray) -> bytes:
    return pa.compress(np.concatenate(arrays).astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _ints(held: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(held, decompressed_size=4 * size, codec="zstd", asbytes=True), np.int32).astype(np.int64)


def _packed(texts: DataFrame) -> DataFrame:
    """Blocks of texts (id, text), in two kinds of rows: (block, base, ids, size, held), base their number, held the number of tokens of each of ids, the steps
    between its token numbers, rising, and their counts; (block, base, tokens, df), the tokens with numbers from base on. Rows of one id are one text."""
    spark = texts.sparkSession
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), k := max(LEAST_BLOCKS, -(-chars // BLOCK_CHARS)))
    words = texts.repartition(n, "id").coalesce(k).sortWithinPartitions("id").select("id", X.tokens_alnum(F.col("text")).alias("w"))
    kinds = StructType([StructField("block", LongType()), StructField("ids", ArrayType(texts.schema["id"].dataType)), StructField("size", IntegerType()), StructField("held", BinaryType()), StructField("base", IntegerType()), StructField("tokens", ArrayType(StringType())), StructField("df", ArrayType(IntegerType()))])
    out = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, book, df, size = TaskContext.get().partitionId() << 32, {}, np.zeros(0, np.int32), 0
        seen = 0

        def row(**x) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": block, **x}], schema=out)

        def texts_row(t: pa.Table) -> tuple[pa.RecordBatch, int]:
            nonlocal df, seen
            seen += 1
            ids = pc.unique(t["id"])
            d, w = pc.index_in(t["id"], value_set=ids).to_numpy(), t["w"].combine_chunks()
            coded = w.flatten().dictionary_encode()
            number = np.fromiter((book.setdefault(x, len(book)) for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            pairs, tf = np.unique(np.repeat(d.astype(np.int64), pc.list_value_length(w).to_numpy()) << 32 | number[coded.indices.to_numpy()], return_counts=True)
            d, code = pairs >> 32, pairs & 0xFFFFFFFF
            df = np.append(df, np.zeros(len(book) - len(df), np.int32)) + np.bincount(code, minlength=len(book)).astype(np.int32)
            sizes = np.bincount(d, minlength=len(ids))
            first = np.append(True, d[1:] != d[:-1]) if len(d) else np.zeros(0, bool)
            return row(base=seen, ids=ids.to_pylist(), size=len(ids) + 2 * len(tf), held=_bytes(sizes, np.where(first, code, np.diff(code, prepend=0)), tf)), len(tf)

        def tokens_rows() -> Iterator[pa.RecordBatch]:
            names = list(book)
            for i in range(0, len(names), TOKENS):
                yield row(base=i, tokens=names[i : i + TOKENS], df=df[i : i + TOKENS].tolist())

        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([left, t]) if left is not None else t
            if not t.num_rows:
                continue
            d = pc.index_in(t["id"], value_set=pc.unique(t["id"])).to_numpy()
            whole = int(np.searchsorted(d, d[-1]))  # the last id may have more rows
            left = t.slice(whole)
            if whole:
                made, more = texts_row(t.slice(0, whole))
                yield made
                size += more
                if size > BLOCK_WORDS:
                    yield from tokens_rows()
                    block, book, df, size = block + 1, {}, np.zeros(0, np.int32), 0
        if left is not None and left.num_rows:
            yield texts_row(left)[0]
        yield from tokens_rows()
        pa.default_memory_pool().release_unused()

    with arrow_batches(spark, TEXTS):
        return written(words.mapInArrow(run, from_arrow_schema(out)), "packed")


def _held(packed: DataFrame) -> DataFrame:
    return packed.where("held IS NOT NULL").select("block", F.col("base").alias("row"), "ids", "size", "held")


def _words(packed: DataFrame) -> DataFrame:
    """(block, code, token, df)."""
    each = packed.where("tokens IS NOT NULL").select("block", "base", F.posexplode(F.arrays_zip("tokens", "df")).alias("i", "x"))
    return each.select("block", (F.col("base") + F.col("i")).alias("code"), F.col("x.tokens").alias("token"), F.col("x.df").alias("df"))


def _numbered(tokens: DataFrame, parts: int) -> DataFrame:
    """tokens with `part` and `row`, their place in the part."""
    dealt = tokens.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)))
    return dealt.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy("token")) - 1)


def _parts(spark, tokens: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TOKENS))


def _links(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(part, block, codes, rows): which number a part's tokens have in a block that has them."""
    met = words.join(vocabulary.select("token", "part", "row"), "token").groupBy("part", "block").agg(F.collect_list(F.struct("code", "row")).alias("x"))
    return written(met.select("part", "block", F.col("x.code").alias("codes"), F.col("x.row").alias("rows")), "links")


FRAMES = pa.schema([("part", pa.int64()), ("at", pa.int32()), ("dims", pa.int32()), ("v", pa.binary())])  # a part's vectors from dimension `at` on; -1: its idf


def _frame(part: int, at: int, m: np.ndarray) -> dict:
    return {"part": part, "at": at, "dims": m.shape[1], "v": m.astype(np.float32).tobytes()}


def _matrix(frames: pa.Table) -> np.ndarray:
    """A part's idf and vectors, side by side."""
    return np.hstack([np.frombuffer(r["v"], np.float32).reshape(-1, r["dims"]) for r in frames.sort_by("at").to_pylist()]).astype(float)


def _start(vocabulary: DataFrame, dims: int) -> DataFrame:
    """Frames of idf and a basis from -1 to 1 by the hash of a token."""

    def made(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        h = t["h"].to_numpy().astype(np.uint64)[:, None] + np.arange(1, dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        v = (mix64(h) & np.uint64((1 << 20) - 1)).astype(float) / (1 << 19) - 1
        return pa.Table.from_pylist([_frame(key[0].as_py(), -1, t["idf"].to_numpy()[:, None]), _frame(key[0].as_py(), 0, v)], schema=FRAMES)

    rows = vocabulary.select("part", "row", "idf", F.xxhash64("token").alias("h"))
    return rows.groupBy("part").applyInArrow(made, from_arrow_schema(FRAMES))


def _of_model(model: DataFrame) -> DataFrame:
    """Frames of (part, row, idf, v)."""

    def made(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return pa.Table.from_pylist([_frame(key[0].as_py(), -1, t["idf"].to_numpy()[:, None]), _frame(key[0].as_py(), 0, v)], schema=FRAMES)

    return model.select("part", "row", "idf", "v").groupBy("part").applyInArrow(made, from_arrow_schema(FRAMES))


SENT = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("codes", pa.binary()), ("rows", pa.binary()), ("v", pa.binary())])


def _sent(links: DataFrame, frames: DataFrame, turn: np.ndarray) -> DataFrame:
    """What parts send to blocks: the idf of the block's tokens and their vectors times `turn`."""

    def made(links: pa.Table, frames: pa.Table) -> pa.Table:
        m = _matrix(frames)
        m = np.hstack([m[:, :1], m[:, 1:] @ turn]).astype(np.float32)
        out = []
        for r in range(links.num_rows):
            codes, rows = (links[c][r].values.to_numpy().astype(np.int32) for c in ("codes", "rows"))
            out.append({"block": links["block"][r].as_py(), "part": links["part"][r].as_py(), "codes": codes.tobytes(), "rows": rows.tobytes(), "v": m[rows].tobytes()})
        return pa.Table.from_pylist(out, schema=SENT)

    return links.groupBy("part").cogroup(frames.groupBy("part")).applyInArrow(made, from_arrow_schema(SENT))


def _received(sent: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(idf, v) by number of the block, zeros where there are none, and the numbers each part has sent."""
    codes = [np.frombuffer(x.as_py(), np.int32) for x in sent["codes"]]
    n = max((int(c.max()) + 1 for c in codes if len(c)), default=0)
    m = np.zeros((n + 1, dims + 1), np.float32)
    for c, v in zip(codes, sent["v"], strict=True):
        m[c] = np.frombuffer(v.as_buffer(), np.float32).reshape(len(c), -1)
    return m[:, 0].astype(float), m[:, 1:], codes


def _texts(block: pa.Table, idf: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, ids, ends, code, w) of a block's texts, some at a time, ends[i] to ends[i + 1] being those of ids[i]: log counts times rarity, each
    text at unit length; tokens without idf weigh 0. A token comes once a text."""
    for i in range(block.num_rows):
        ids = block["ids"][i].values
        held = _ints(block["held"][i].as_py(), block["size"][i].as_py())
        sizes, (step, tf) = held[: len(ids)], np.split(held[len(ids) :], 2)
        ends, run = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(step))
        code = np.minimum(run[1:] - np.repeat(run[ends[:-1]], sizes), len(idf) - 1)
        raw = (1 + np.log(np.arange(1, tf.max(initial=1) + 1)))[tf - 1] * idf[code]
        length = np.sqrt(np.add.reduceat(np.append(raw * raw, 0.0), ends[:-1]) * (sizes > 0))
        yield block["row"][i].as_py(), ids, ends, code, (raw / np.repeat(np.where(length > 0, length, 1.0), sizes)).astype(np.float32)


def _sums(ends: np.ndarray, code: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A text's vector each: its tokens' vectors times their weights."""
    got, t = v[code], np.zeros((len(ends) - 1, v.shape[1]), np.float32)
    for i in range(len(t)):
        a, b = ends[i], ends[i + 1]
        np.dot(w[a:b], got[a:b], out=t[i])
    return t


def _back(packed: DataFrame, sent: DataFrame, dims: int) -> DataFrame:
    """What blocks send back to parts: sums of their tokens over their texts, of sums of their texts over their tokens."""

    def made(block: pa.Table, sent: pa.Table) -> pa.Table:
        idf, v, codes = _received(sent, dims)
        sums = np.zeros((len(idf), dims))
        for _, _, ends, code, w in _texts(block, idf):
            for t, a, b in zip(_sums(ends, code, w, v), ends, ends[1:], strict=False):
                sums[code[a:b]] += w[a:b, None] * t
        sums = sums.astype(np.float32)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([sent["block"], sent["part"], sent["codes"], sent["rows"], pa.array([sums[c].tobytes() for c in codes], pa.binary())], schema=SENT)

    return _held(packed).groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(made, from_arrow_schema(SENT)).select("part", "rows", "v")


def _added(back: DataFrame, at: int, dims: int) -> DataFrame:
    """Frames from dimension `at` on: what comes back to each part, added up."""

    def made(key: tuple, t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), np.int32) for x in t["rows"]]
        out = np.zeros((max(int(r.max()) for r in rows) + 1, dims))
        for r, v in zip(rows, t["v"], strict=True):
            out[r] += np.frombuffer(v.as_buffer(), np.float32).reshape(len(r), -1)  # a part sends a block no token twice
        return pa.Table.from_pylist([_frame(key[0].as_py(), at, out)], schema=FRAMES)

    return back.groupBy("part").applyInArrow(made, from_arrow_schema(FRAMES))


def _gram(frames: DataFrame, dims: int) -> np.ndarray:
    """The sum of v v' over all tokens: one matrix a part, then one for all."""
    cells = pa.schema([("cell", pa.int64()), ("x", pa.float64())])

    def part(t: pa.Table) -> pa.Table:
        m = _matrix(t)
        return pa.table([np.arange(dims * dims), (m.T @ m).ravel()], schema=cells)

    g = np.zeros(dims * dims)
    with shuffles_freed(frames.sparkSession):
        got = frames.groupBy("part").applyInArrow(part, from_arrow_schema(cells)).groupBy("cell").agg(F.sum("x").alias("x")).collect()  # dims * dims rows
    for r in got:
        g[r["cell"]] = r["x"]
    return g.reshape(dims, dims)


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    """What written() gives, and where it is."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "frames")
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@dataclass
class _Fitted:
    """vocabulary (token, n, idf, part, row); frames of it, whose vectors times turn are those of the model."""

    packed: DataFrame
    vocabulary: DataFrame
    links: DataFrame
    frames: DataFrame
    turn: np.ndarray


def _fitted(texts: DataFrame, dims: int, rounds: int) -> _Fitted:
    spark, packed = texts.sparkSession, _packed(texts)
    words = _words(packed)
    total = texts.select("id").distinct().agg(F.count("*").alias("n_texts"))  # one row
    found = words.groupBy("token").agg(F.sum("df").alias("n")).where("n > 1").crossJoin(F.broadcast(total)).select("token", "n", F.ln((F.col("n_texts") + 1) / F.col("n")).alias("idf"))
    found = written(found, "tokens")
    vocabulary = written(_numbered(found, _parts(spark, found.count())), "vocabulary")
    links = _links(words, vocabulary)
    start, path = _kept(_start(vocabulary, dims))
    idf, turn, paths = written(start.where("at < 0"), "idf"), np.eye(dims), [path]
    frames = start
    for _ in range(rounds):
        slices = []
        for at in range(0, turn.shape[1], SLICE):
            some = turn[:, at : at + SLICE]
            with arrow_batches(spark, 64):
                slices.append(_kept(_added(_back(packed, _sent(links, frames, some), some.shape[1]), at, some.shape[1])))
        for x in paths:
            remove(spark, x)  # the basis of the round before
        back, dims, paths = slices[0][0], turn.shape[1], [x for _, x in slices]
        for x, _ in slices[1:]:
            back = back.union(x)
        values, vectors = np.linalg.eigh(_gram(back, dims))
        kept = values > RANK * max(values.max(initial=0.0), 1e-300)
        frames, turn = idf.union(back), vectors[:, kept] / np.sqrt(values[kept])
        if not kept.any():
            break
    return _Fitted(packed, vocabulary, links, frames, turn)


def fit(texts: DataFrame, dims: int = DIMS, rounds: int = ROUNDS) -> DataFrame:
    """A model (token, n, idf, v) of texts (id, text): n texts hold the token, v are `dims` numbers, fewer if the corpus has no
    more directions. Tokens of one text only are left out: no other text can be found by them. Reruns agree."""
    got = _fitted(texts, dims, rounds)
    turn = got.turn
    kinds = pa.schema([("token", pa.string()), ("n", pa.int64()), ("idf", pa.float64()), ("v", pa.list_(pa.float64()))])

    def made(tokens: pa.Table, frames: pa.Table) -> pa.Table:
        if not tokens.num_rows or not frames.num_rows or not turn.shape[1]:
            return kinds.empty_table()
        tokens, v = tokens.sort_by("row"), _matrix(frames)[:, 1:] @ turn
        listed = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel())
        return pa.table([tokens["token"], tokens["n"], tokens["idf"], listed], schema=kinds)

    return got.vocabulary.groupBy("part").cogroup(got.frames.groupBy("part")).applyInArrow(made, from_arrow_schema(kinds))


def _embedded(texts: DataFrame, packed: DataFrame, links: DataFrame, frames: DataFrame, turn: np.ndarray) -> DataFrame:
    spark, dims = texts.sparkSession, turn.shape[1]
    if not dims:
        return texts.select("id").withColumn("embedding", F.array().cast("array<float>"))
    some = to_arrow_schema(StructType([StructField("block", LongType()), StructField("row", IntegerType()), StructField("at", IntegerType()), StructField("dims", IntegerType()), StructField("ids", ArrayType(texts.schema["id"].dataType)), StructField("v", BinaryType())]))
    kinds = to_arrow_schema(StructType([texts.schema["id"]])).append(pa.field("embedding", pa.list_(pa.float32())))

    def part(at: int, n: int) -> DataFrame:
        def made(block: pa.Table, sent: pa.Table) -> pa.Table:
            idf, v, _ = _received(sent, n)
            out = [{"block": block["block"][0].as_py(), "row": row, "at": at, "dims": n, "ids": None if at else ids.to_pylist(), "v": _sums(ends, code, w, v).tobytes()} for row, ids, ends, code, w in _texts(block, idf)]
            pa.default_memory_pool().release_unused()
            return pa.Table.from_pylist(out, schema=some)

        sent = _sent(links, frames, turn[:, at : at + n]).groupBy("block")
        return written(_held(packed).groupBy("block").cogroup(sent).applyInArrow(made, from_arrow_schema(some)), "embedded")

    def unit(t: pa.Table) -> pa.Table:
        m, ids = _matrix(t), t.sort_by("at")["ids"][0].values
        length = np.sqrt((m * m).sum(1))
        at = np.flatnonzero(length > 0)
        m = (m[at] / length[at, None]).astype(np.float32)
        listed = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * dims, m.ravel())
        return pa.table([ids.take(pa.array(at)).cast(kinds.field(0).type), listed], schema=kinds)

    with arrow_batches(spark, 64):
        parts = [part(at, min(SLICE, dims - at)) for at in range(0, dims, SLICE)]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.union(x)
    units = whole.groupBy("block", "row").applyInArrow(unit, from_arrow_schema(kinds))
    return texts.select("id").join(units, "id", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))


def encode(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(id, embedding) of texts (id, text) at unit length; a text without a token of the model is an empty array."""
    dims = (model.agg(F.max(F.size("v")).alias("d")).first()["d"]) or 0
    if not dims:
        return texts.select("id").withColumn("embedding", F.array().cast("array<float>"))
    packed = _packed(texts)
    words = _words(packed)
    own = model.join(words.select("token").distinct(), "token", "left_semi").select("token", "idf", "v")
    own = _numbered(own, _parts(texts.sparkSession, words.count()))
    return _embedded(texts, packed, _links(words, own), written(_of_model(own), "frames"), np.eye(dims))


@query("learned_vectors")
def _learned(spark, d):
    """Every document by a model fitted on all of them; numbers that do not depend on the basis's signs."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    model = _fitted(docs, DIMS, ROUNDS)  # the texts are those of the model, so that what was packed for it serves again
    got = _embedded(docs, model.packed, model.links, model.frames, model.turn)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return got.select("id", F.size("embedding").alias("dims"), F.round(square, 4).alias("length"))
