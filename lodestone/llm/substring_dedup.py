"""Exact substring de-duplication by seed and extend on winnowed anchors.

Seeds. A document's 16-word grams are hashed, and a gram that is the minimum of some run of 35 grams is
an anchor (all of them on ties). A window of 50 words is one such run, so two equal windows share an
anchor at the same place. Anchors, about one for 18 words, are joined; windows are not.

Extension. An occurrence of an anchor is extended 34 words both ways, or to the document's ends: as far as
a window that holds it can reach. Occurrences whose whole extension agrees are one class, and all but
those of the class's smallest document repeat text of that document. Where an anchor has several classes,
one occurrence of each is extended word by word: each window of which it is the lowest gram is one row (so a window
is one row of a document), grouped over all classes, and repeats if a smaller document has it. So a passage in m
documents costs in proportion to m, and no pairs of documents are formed. A class's hash covers its anchor, so it
stands for both.

Maximal repeats. A run of repeated windows that start at consecutive words is a maximal repeat: neither its
first nor its last word can be extended by another repeated window. Each is kept as its first word and the
word after its last, 50 words apart at least; the words between go.

Rows, not ids, carry text: a row is known by the hash of its doc_id and text, and doc_id only says which
document is smaller. Joins on anchors, windows and classes deal hot keys over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import Memo, _to_arrow, cut, cut_to, mix64, remove, spread_join, utf8

WINDOW, GRAM = 50, 16
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided out modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
SEED = "anchor long, around long, doc_id long, key long, pos int"
WINDOWS = "around long, doc_id long, back int, window long"


class Hasher:
    """The hash of any run of a document's words in constant time, from prefix sums modulo 2^64."""

    def __init__(self):
        self.words = Memo(lambda w: xxhash.xxh64_intdigest(w, 7))
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if len(self.up) <= n:
            k = 1 << (n + 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(k - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE))
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        return np.r_[np.uint64(0), np.cumsum(h * self.up[:n], dtype=np.uint64)]

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words[start:end], the same wherever the run stands; the length is mixed in."""
        return mix64(((prefix[end] - prefix[start]) * self.down[start]) ^ mix64((end - start).astype(np.uint64)))


def extreme(h: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over h[i : i + width] for every whole window, by doubling."""
    have, m = 1, h
    while have < width:
        step = min(have, width - have)
        m = pick(m[: len(m) - step], m[step:])
        have += step
    return m


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the minimum of some whole window of `width` hashes."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    edge = np.zeros(width - 1, np.uint64)
    highest = extreme(np.r_[edge, extreme(h, width), edge], width, np.maximum)  # of the minima of all windows around a place
    return np.flatnonzero(highest == h)


class Seeds:
    """The Python side of the operator, for one window and gram length."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.reach = window, gram, window - gram
        if not 0 < gram <= window or self.reach > 62:
            raise ValueError("the gram must be shorter than the window, by 62 words at most")

    def seed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, around, doc_id, key, pos) of every anchor; around hashes its whole extension."""
        out, hasher = _to_arrow(SEED), Hasher()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), utf8(batch), strict=True):
                words = (text or b"").split()
                n = len(words)
                if n < self.window or doc is None:
                    continue
                prefix, start = hasher.prefix(words), np.arange(n - self.gram + 1)
                h = hasher.runs(prefix, start, start + self.gram)
                at = anchors(h, self.reach + 1)
                left, right = np.maximum(at - self.reach, 0), np.minimum(at + self.window, n)
                around = mix64(hasher.runs(prefix, left, right) + (at - left).astype(np.uint64))
                for c, x in zip(cols, (h[at].view(np.int64), around.view(np.int64), np.full(len(at), doc), np.full(len(at), key), at), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def extend(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, packed, found: [(pos, around)]) -> a row for each window of which a seed is the lowest gram."""
        out, hasher, unpack = _to_arrow(WINDOWS), Hasher(), zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for doc, packed, found in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), batch.column("found").to_pylist(), strict=True):
                words = unpack.decompress(packed).split()
                n, prefix = len(words), hasher.prefix(words)
                place = np.arange(n - self.gram + 1)
                h = hasher.runs(prefix, place, place + self.gram)
                lowest = extreme(h, self.reach + 1)
                for seed in found:
                    pos = seed["pos"]
                    start = max(0, pos - self.reach) + np.flatnonzero(lowest[max(0, pos - self.reach) : pos + 1] == h[pos])
                    made = hasher.runs(prefix, start, start + self.window)
                    for c, x in zip(cols, (np.full(len(start), seed["around"]), np.full(len(start), doc), pos - start, made.view(np.int64)), strict=True):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def maximal(self, n: int, found: list[dict]) -> list[tuple[int, int]]:
        """The maximal repeats (first word, word after the last) of n words; bit j of a mask is the window from pos - j."""
        pos, mask = (np.fromiter((f[k] for f in found), np.int64, len(found)) for k in ("pos", "mask"))
        hit, back = np.nonzero(mask[:, None] >> np.arange(self.reach + 1) & 1)
        s = np.unique(pos[hit] - back)
        s = s[(s >= 0) & (s <= n - self.window)]
        if not len(s):
            return []
        new = np.flatnonzero(np.diff(s) > 1)
        return list(zip(s[np.r_[0, new + 1]].tolist(), (s[np.r_[new, len(s) - 1]] + self.window).tolist(), strict=True))

    def strip(self, batches: Iterator[pa.RecordBatch], schema: str, kept_text: bool) -> Iterator[pa.RecordBatch]:
        """(doc_id, key, packed, found) -> the row without its maximal repeats, which `repeats` lists."""
        out, unpack = _to_arrow(schema.replace(", repeats array<struct<start:long,stop:long>>", "")), zstandard.ZstdDecompressor()
        out = out.append(pa.field("repeats", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
        for batch in batches:
            rows = []
            for doc, key, packed, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "packed", "found")), strict=True):
                text = None if packed is None else unpack.decompress(packed)
                words = (text or b"").split()
                repeats = self.maximal(len(words), found) if found else []
                gone = np.zeros(len(words), bool)
                for start, stop in repeats:
                    gone[start:stop] = True
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if repeats else words
                row = [doc, key, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()]
                rows.append([*row, *([cut_out(text, gone) if repeats else text] if kept_text else []), [{"start": s, "stop": e} for s, e in repeats]])
            if rows:
                cols = [pa.array(c, pa.binary()).cast(pa.string()) if f.name == "kept" else pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=out)


def cut_out(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked as gone; lines that lose all their words go with them."""
    out, at = [], 0
    for line in text.split(b"\n"):
        words = line.split()
        left = [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g]
        at += len(words)
        if len(left) == len(words):
            out.append(line)
        elif left:
            out.append(b" ".join(left))
    return b"\n".join(out)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts squeezed one by one: they cross two shuffles."""
    out, squeeze = _to_arrow("doc_id long, key long, packed binary"), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([None if t is None else squeeze.compress(t) for t in utf8(batch)], pa.binary())], schema=out)


def strip_repeats(docs: DataFrame, kept_text: bool = False, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept_sha256[, kept], repeats), one row a row of docs; key is
    xxhash64(doc_id, text), and repeats lists the row's maximal repeats as {start, stop} in words.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller
    doc_id. Null and empty texts have no words and lose none (a null text's `kept` is null); texts
    shorter than the window keep all; a very long text is one row, whole. A null doc_id is neither smaller nor
    larger than another: that row keeps all. Of rows that repeat a doc_id none is smaller, whatever their texts; each
    loses what smaller documents have. An empty table gives no rows. Other columns of docs, whatever their
    names, are not read."""
    at = Seeds(window, gram)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")
    every, every_path = cut_to(docs.mapInArrow(at.seed, SEED), "anchors")
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n")
    seen = cut(spread_join(every, cut(shared, "repeated"), ["anchor"], every.count(), by="key"), "shared")
    remove(docs.sparkSession, every_path)
    n_seen = seen.count()

    # an anchor's classes; of those with several, a seed each: the first occurrence in the smallest document
    classes = cut(seen.groupBy("around").agg(F.first("anchor").alias("anchor"), F.min(F.struct("doc_id", "pos", "key")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "classes")
    several = classes.groupBy("anchor").agg(F.min("first.doc_id").alias("lo"), F.max("first.doc_id").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("anchor", "m")
    chosen = spread_join(classes.select("anchor", "around", "first"), several, ["anchor"], n_seen, "m", by="around")
    seeds = chosen.groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "around")).alias("found"))
    packed = docs.mapInArrow(_pack, "doc_id long, key long, packed binary")
    once = packed.where("packed IS NOT NULL").join(seeds.hint("shuffle_hash"), "key")
    windows, windows_path = cut_to(once.select("doc_id", "packed", "found").mapInArrow(at.extend, WINDOWS), "windows")
    older = windows.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    repeated = spread_join(windows, older, ["window"], windows.count(), by="around").where("doc_id > lo")
    masks = repeated.groupBy("around").agg(F.bit_or(F.expr("shiftleft(1L, back)")).alias("mask"))

    rule = classes.join(masks, "around", "left").select("around", F.col("first.doc_id").alias("first"), "mask", "last", "n").where("mask IS NOT NULL OR first < last").drop("last")
    ruled = spread_join(seen.drop("anchor"), cut(rule, "rule"), ["around"], n_seen, by="key")
    remove(docs.sparkSession, windows_path)
    hits = ruled.select("key", "pos", F.when(F.col("doc_id") > F.col("first"), F.lit((1 << (at.reach + 1)) - 1)).otherwise(F.col("mask")).alias("mask")).where("mask IS NOT NULL")
    found = hits.groupBy("key").agg(F.collect_set(F.struct("pos", "mask")).alias("found"))  # a set: rows that repeat have one key
    schema = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept_text + ", repeats array<struct<start:long,stop:long>>"
    return packed.join(found.hint("shuffle_hash"), "key", "left").mapInArrow(lambda b: at.strip(b, schema, kept_text), schema)


def maximal_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, start, stop): the maximal repeats themselves, a row each, in words of the row's text."""
    return strip_repeats(docs, window=window, gram=gram).select("doc_id", "key", F.inline("repeats"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of text (and n_chars set anew); documents that lose every word go.

    Nulls, empty and long texts, repeated ids and an empty table as for strip_repeats; a null text stays null. All
    columns of docs stay, extra ones too, but for names that start with `__`."""
    kept = strip_repeats(docs, kept_text=True).where("n_removed = 0 OR n_removed < n_words").select(F.col("key").alias("__key"), F.col("kept").alias("__kept")).dropDuplicates(["__key"])
    out = docs.withColumn("__own", F.xxhash64(F.col("doc_id").cast("long"), "text")).drop("text").join(kept, F.col("__own") == F.col("__key"))
    made = out.withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(c) for c in docs.columns])


#: The contract word for word, for DuckDB: every window of 50 words, and the smallest document it starts in.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
win AS (SELECT doc_id, i, list_aggregate(words[i:i+49], 'string_agg', ' ') AS seq FROM w, range(1, greatest(1, len(words) - 48)) r(i)),
lo AS (SELECT seq, min(doc_id) AS first FROM win GROUP BY seq HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM win JOIN lo USING (seq), range(0, 50) o(k) WHERE doc_id > first),
word AS (SELECT doc_id, i AS place, words[i] AS word FROM w, range(1, len(words) + 1) r(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
