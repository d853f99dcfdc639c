"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most t = 3 bits, some
segment starts a chain along the ring whose cumulative differences stay within the proportional budgets
floor(l * t / 4) for l = 1..4 segments: 0, 1, 2, 3. The first three budgets make the join key: the first
segment agrees whole, one of the second's two halves agrees (at most 1 difference), and one of the
third's three parts agrees (at most 2). That is 24 keys of 29 or 30 bits a fingerprint. Pairs that share a key are
tested chain by chain, and only survivors reach the full Hamming count.

Texts with one fingerprint are one class before any pair is formed. A key's classes are dealt into cells
of about CELL rows (block pairs), so no task holds an unbounded key; a cell returns the links of a
spanning forest, not its pairs, and components over classes finish the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.jaccard_dedup import SIMILAR, WIDTH, similar_groups
from lodestone.llm.shared import _to_arrow, arrow_map, components, cut, fan_out, spread_join, utf8

BUDGETS = (0, 1, 2, 3)  # floor(l * 3 / 4) differing bits for chains of 1..4 segments
PARTS = ((0, 5), (5, 5), (10, 6))  # the third segment's parts: first bit, bits
CELL = 4096
_FULL = (1 << 64) - 1


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lower-cased, only ASCII space splits
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, n).view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, one row a row of docs."""

    def run(batch):
        fps = np.fromiter(map(fingerprint, utf8(batch)), np.uint64, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def _keys(fp):
    """The 24 chain keys of a fingerprint column, each with its chain's number in the top bits."""
    seg = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    out = []
    for i in range(4):
        for half in range(2):
            for part, (at, bits) in enumerate(PARTS):
                b = F.shiftrightunsigned(seg[(i + 1) % 4], 8 * half).bitwiseAND(F.lit(0xFF))
                c = F.shiftrightunsigned(seg[(i + 2) % 4], at).bitwiseAND(F.lit((1 << bits) - 1))
                out.append(F.lit(((i * 2 + half) * 3 + part) << 32) + F.shiftleft(seg[i], 14) + F.shiftleft(b, 6) + c)
    return F.array(*out)


def _chain_masks(key: int) -> list[np.uint64]:
    start = (key >> 32) // 6
    masks, m = [], 0
    for l in range(4):
        m |= 0xFFFF << (16 * ((start + l) % 4))
        masks.append(np.uint64(m & _FULL))
    return masks


def linked(one: np.uint64, others: np.ndarray, masks: list[np.uint64]) -> np.ndarray:
    """Positions in `others` within the budgets of every prefix of the chain; the last is the full count."""
    at = np.arange(len(others))
    diff = others ^ one
    for mask, most in zip(masks, BUDGETS, strict=True):
        ok = np.bitwise_count(diff & mask) <= most
        at, diff = at[ok], diff[ok]
        if not len(at):
            break
    return at


def _forest(fps: np.ndarray, reps: np.ndarray, key: int) -> list[tuple[int, int]]:
    """Links that join the classes of one cell as its pairs would: one a class beyond each group's first."""
    masks, links = _chain_masks(key), []
    left = np.argsort(reps, kind="stable")
    while len(left) > 1:
        root, todo, left = reps[left[0]], [left[0]], left[1:]
        while todo and len(left):
            got = linked(fps[todo.pop()], fps[left], masks)
            if len(got):
                new = left[got]
                links += [(int(reps[j]), int(root)) for j in new]
                todo += new.tolist()
                left = np.delete(left, got)
    return links


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, fp, rep) sorted by key and cell -> links (a, b). Holds one cell at a time."""
    out = _to_arrow("a long, b long")
    held: list[tuple] = []

    def flush(parts):
        fps, reps = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        return _forest(fps.view(np.uint64), reps, parts[0][0][0]) if len(fps) > 1 else []

    for batch in batches:
        key, cell, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        links = []
        for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            at = (int(key[s]), int(cell[s]))
            if held and held[0][0] != at:
                links += flush(held)
                held = []
            held.append((at, fp[s:e], rep[s:e]))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)
    if held and (links := flush(held)):
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)


def class_links(classes: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b): links between classes (fp, rep) that join them as all pairs within 3 bits would."""
    spark = classes.sparkSession
    rows = classes.select("fp", "rep", F.explode(_keys(F.col("fp"))).alias("key"))
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(cell)).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    n = classes.count() * 24
    dealt = (
        spread_join(rows, blocks, ["key"], n, by="fp")
        .select("key", "fp", "rep", "blocks", own.alias("own"), other.alias("other"))
        .select("key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("cell"), "fp", "rep")
    )
    return dealt.repartition(fan_out(spark), "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_search, "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a row of docs; every link within 3 bits counts.

    Null or wordless texts have fingerprint zero and link like any other; a very long text is read whole. Rows
    that repeat a doc_id each get their row. A null doc_id gets its class's component and never names one; a class
    in which every doc_id is null forms no links and has a null component_id. Ties between texts do not arise: the
    smallest doc_id names. An empty table gives no rows. Other columns of docs, whatever their names, are not read."""
    fps = cut(fingerprints(docs, doc_id, text), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    roots = components(class_links(classes.where("rep IS NOT NULL")))
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n")
    return spread_join(fps, named, ["fp"], fps.count(), by="doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs without all but one document of each near-duplicate group: the one with the smallest doc_id.

    Candidates are the groups of op1's fingerprints within 3 bits, and those that MinHash bands add to them: fingerprints
    alone miss most pairs near the bound. An exact check follows: near-duplicates are documents whose sets of `width`-word
    shingles have a Jaccard similarity of `similar` (a fraction) at least, or a chain of such.

    Rows that repeat the kept doc_id all stay; rows with a null doc_id stay. Null and empty texts are one group;
    long texts count whole. An empty table gives an empty one. All columns of docs stay, whatever their names, but
    for `__doc`."""
    groups = similar_groups(docs, width, similar, found=near_groups(docs)).select(F.col("doc_id").alias("__doc"), "component_id").where("component_id < __doc").select("__doc").distinct()
    return docs.join(groups, docs.doc_id == groups["__doc"], "left_anti")
