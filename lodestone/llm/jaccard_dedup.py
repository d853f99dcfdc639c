"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands and sketches find them, exact sets decide.

A text is the set of its 5-word shingles. Texts with equal sets are one class.

1. BANDS keys of ROWS MinHash values a class: a pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS,
   0.999995 at 0.8.
2. Classes of a key are compared by sketches, four bits of each MinHash value: of the 240 about 195 agree at 0.8, and a
   pair in which LIKE or more do is a coarse link (all but some 1 in 5,000 at 0.8; at 0.6, as between the pages of one
   template, 1 in 500 of those that share a key). So a template's pages do not chain into one group by chance keys.
3. Components of the coarse links are groups; every pair of classes within a group is compared by the sets themselves,
   so a pair below the bound never links.

A key's classes and a group's sets are dealt into cells (block pairs) of bounded size, so no task holds an unbounded one;
a cell returns the links of a spanning forest, not its pairs, and components over classes finish the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, components, cut, fan_out, mix64, spread_join, utf8

WIDTH = 5  # words a shingle
SIMILAR = (4, 5)  # least similarity, as a fraction
BANDS, ROWS = 40, 6
LIKE = 168  # agreeing entries of two sketches from which their sets are compared
CELL = 1 << 18  # shingles
KEY_CELL = 4096  # classes
_FACTORS, _TERMS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS |= np.uint64(1)
_STEP = 1 << 21  # postings looked at together


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The ascending hashes of a text's word shingles, each once; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lower-cased, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64))


def class_of(found: np.ndarray) -> int:
    """The class of a set of shingles: a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def band_keys(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The BANDS keys of a set of shingles, and its sketch; an empty set has neither."""
    if not len(found):
        return np.zeros(0, np.int64), b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (found[i : i + 1024, None] * _FACTORS + _TERMS).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        key = mix64(key ^ value) + np.uint64(1)
    low = (mix64(least) & np.uint64(15)).astype(np.uint8)
    return key.view(np.int64), (low[::2] << 4 | low[1::2]).tobytes()


def alike(nodes: np.ndarray, sketches: np.ndarray, like: int = LIKE) -> list[tuple[int, int]]:
    """Links that join nodes as all pairs of sketches (a row each) with `like` agreeing entries would."""
    left, links, ours = np.arange(len(nodes)), [], np.concatenate([sketches >> 4, sketches & 15], 1)
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            got = (ours[left] == ours[one]).sum(1) >= like
            if got.any():
                new = left[got]
                links += [(int(nodes[j]), int(nodes[one])) for j in new]
                todo += new.tolist()
                left = left[~got]
    return links


def forest(nodes: np.ndarray, sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Links that join sets as all pairs of at least the similarity would: one a set beyond each group's first."""
    up, down = similar
    size = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(size)]
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    start = np.r_[0, np.cumsum(often)]
    left, links = np.ones(len(sets), bool), []

    def near(one: int) -> np.ndarray:
        codes = code[at[one] : at[one + 1]]
        codes = codes[often[codes] > 1]
        both = np.zeros(len(sets), np.int64)
        ends = np.cumsum(often[codes])
        a = 0
        while a < len(codes):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _STEP)))
            n = often[codes[a:b]]
            both += np.bincount(owner[np.repeat(start[codes[a:b]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], minlength=len(sets))
            a = b
        return np.flatnonzero(left & (both * (up + down) >= up * (size[one] + size)))

    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo and left.any():
            one = todo.pop()
            new = near(one)
            left[new] = False
            links += [(int(nodes[j]), int(nodes[one])) for j in new]
            todo += new.tolist()
    return links


def _cells(batches: Iterator[pa.RecordBatch], links: Callable[[np.ndarray, list[bytes]], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Rows (group, cell, node, found) sorted by group and cell -> links (a, b). Holds one cell at a time."""
    out = _to_arrow("a long, b long")
    now, held = None, {}

    def flush():
        if len(held) > 1 and (made := links(np.array(list(held), np.int64), list(held.values()))):
            a, b = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    for batch in batches:
        group, cell, node = (batch.column(i).to_pylist() for i in range(3))
        for k, found in enumerate(batch.column(3)):
            if (group[k], cell[k]) != now:
                yield from flush()
                now, held = (group[k], cell[k]), {}
            held[node[k]] = found.as_py()
    yield from flush()


def _links_in(rows: DataFrame, sizes: DataFrame, n: int, links: Callable) -> DataFrame:
    """(a, b): links(nodes, what was found of them) within each group of rows (group, node, found), over all pairs of blocks.

    sizes (group, rows, blocks) says how many rows a group has and into how many blocks they go; n counts all rows."""
    spark = rows.sparkSession
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (
        spread_join(rows, sizes, ["group"], n, "rows", by="node")
        .select("group", "node", "found", "blocks", own.alias("own"), other.alias("other"))
        .select("group", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("cell"), "node", "found")
    )
    return dealt.repartition(fan_out(spark), "group", "cell").sortWithinPartitions("group", "cell").mapInArrow(partial(_cells, links=links), "a long, b long")


def like_links(keys: DataFrame, sketches: DataFrame, like: int = LIKE, cell: int = KEY_CELL) -> DataFrame:
    """(a, b): links between the nodes of keys (node, key) that join each key's as all its pairs of like sketches would.

    sketches is (node, sketch). Only keys of two nodes or more get as far as the sketches."""
    n = keys.count()
    shared = keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = cut(shared.select(F.col("key").alias("group"), "rows", F.ceil(F.col("rows") / F.lit(cell)).alias("blocks")), "shared")
    met = spread_join(keys.select(F.col("key").alias("group"), "node"), shared.drop("blocks"), ["group"], n, "rows", by="node")
    met = met.join(sketches.select("node", F.col("sketch").alias("found")), "node")
    return _links_in(met, shared, n, partial(_alike_bytes, like=like))


def _alike_bytes(nodes: np.ndarray, found: list[bytes], like: int) -> list[tuple[int, int]]:
    return alike(nodes, np.frombuffer(b"".join(found), np.uint8).reshape(len(nodes), -1), like)


def _forest_bytes(nodes: np.ndarray, found: list[bytes], similar: tuple[int, int]) -> list[tuple[int, int]]:
    return forest(nodes, [np.frombuffer(f, np.uint64) for f in found], similar)


def similar_links(sets: DataFrame, similar: tuple[int, int] = SIMILAR, cell: int = CELL) -> DataFrame:
    """(a, b): links between the nodes of (root, node, n, found) that join each root's as all its similar pairs would."""
    sizes = sets.groupBy(F.col("root").alias("group")).agg(F.count("*").alias("rows"), F.ceil(F.sum("n") / F.lit(cell)).alias("blocks"))
    return _links_in(sets.select(F.col("root").alias("group"), "node", "found"), sizes, sets.count(), partial(_forest_bytes, similar=similar))


def similar_groups(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, doc_id: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id), one row a row of docs: documents joined by chains of pairs of at least the similarity.

    `found` (doc_id, component_id) are groups that another method found: their documents are compared by their sets too.

    Null or wordless texts are one class; a very long text is read whole. Rows that repeat a doc_id each get their
    row. A null doc_id gets its class's component and never names one; a class in which every doc_id is null forms no links and has a null
    component_id. An empty table gives no rows. Other columns of docs are not read."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in utf8(batch)]
            keys, sketches = zip(*map(band_keys, found), strict=True) if found else ((), ())
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(map(class_of, found), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "keys", "sketch"])

    marks = cut(read.mapInArrow(marked, "doc_id long, h long, node long, keys array<long>, sketch binary"), "marks")
    named = marks.where("doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "h")).alias("first")  # the row that stands for a class, and its text
    classes = cut(named.groupBy("node").agg(first, F.count("*").alias("n")).select("node", "first.*", "n"), "classes").withColumnRenamed("doc_id", "rep")
    n_marks, n_classes = marks.count(), classes.count()
    own = spread_join(named, classes.withColumnRenamed("h", "own"), ["node"], n_marks, by="doc_id").where("doc_id = rep AND h = own")
    held = cut(own.dropDuplicates(["node"]).select("node", "keys", "sketch"), "keys")
    links = like_links(held.select("node", F.explode(F.array_distinct("keys")).alias("key")), held.select("node", "sketch"))
    if found is not None:
        members = named.select("doc_id", "node").distinct().join(found.select("doc_id", F.col("component_id").alias("group")).distinct(), "doc_id").select("group", "node").distinct()
        members = cut(members.join(held.select("node"), "node"), "members")
        first = members.groupBy("group").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
        links = links.union(spread_join(members, first, ["group"], n_marks, by="node").select(F.col("node").alias("a"), "b"))
    coarse = components(links)
    coarse = coarse.union(coarse.select("root", "root").distinct())  # components leave out the roots themselves

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The set of each class, once a task: rows that repeat the class's own row bring it again."""
        out, seen = _to_arrow("root long, node long, n long, found binary"), set()
        for batch in batches:
            root, node = batch.column("root").to_pylist(), batch.column("node").to_pylist()
            made = []
            for r, k, t in zip(root, node, utf8(batch), strict=True):
                if k not in seen:
                    found = shingles(t, width)
                    if class_of(found) == k:  # else another text under the same hash
                        seen.add(k)
                        made.append((r, k, len(found), found.tobytes()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    wanted = classes.join(coarse, "node").select(F.col("rep").alias("doc_id"), "h", "root", "node", "n")
    sets = cut(spread_join(read, wanted, ["doc_id", "h"], n_marks, by="h").select("root", "node", "text").mapInArrow(whole, "root long, node long, n long, found binary"), "sets")
    joined = components(similar_links(sets, similar))
    grouped = classes.join(joined, "node", "left").select("node", "rep", "n", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("m"))
    of = cut(spread_join(grouped, least, ["root"], n_classes, "m", by="node").select("node", "component_id", "n"), "named")
    none = marks.where("doc_id IS NULL").select("doc_id", "node").join(of.drop("n"), "node", "left").select("doc_id", "component_id")
    return spread_join(named.select("doc_id", "node"), of, ["node"], n_marks, by="doc_id").select("doc_id", "component_id").union(none)
