"""Spelling variants: one-edit pairs of a vocabulary by merging the light subtrees of its trie.

Two words one edit apart share a path of the trie down to a node p and part there: one goes on by character a, the
other by b or ends. Of p's branches the one with the most words is heavy; a word leaves heavy paths at most
log2(words) times, and only there is it copied, small into large:

- with the character skipped: the word without a. It coincides with a word that goes on by the rest, or ends;
- with the character replaced: by the heavy one, to coincide with a word of the heavy branch; and by a mark that
  stands for any, to coincide with the copies of the other light branches of p;
- with the heavy character put in before it: to coincide with a word of the heavy branch that has one more.

So every pair is met at its own p, once. A copy is the 127-bit hash of the word it spells, worked out from the hashes
of its prefix and suffix; coinciding terminals are an equi-join of copies with words, and a grouping of the marked
copies, whose members are all near each other and are counted, not paired. Links found by the join are checked on the
words themselves; nodes and marked copies rest on their 127 bits. Nodes are rows (the hash of a prefix), so the
trie is spread over tasks, however large.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, cut, cut_to, remove, spread_join, utf8

RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")  # [A-Za-zÀ-ÿ]+ in UTF-8
DAMAGE = 97  # one in so many runs of a document loses a code point
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
KEPT = 200_000  # distinct words that a task counts before it passes them on
PRIME = (1 << 127) - 1
BASE = int.from_bytes(np.random.default_rng(12).bytes(15), "little")
ANY = 0x110000  # a mark outside Unicode


def _runs(text: bytes) -> Counter:
    """The maximal runs of letters of a text, A-Z lower-cased, with their numbers."""
    return Counter(RUN.findall(text.lower()))  # bytes: only A-Z are lower-cased


def damaged(run: bytes, seed: int) -> bytes:
    """A run without the code point at h % length if 97 divides h, the crc32 of what `seed` has seen and the run."""
    h = zlib.crc32(run, seed)
    if h % DAMAGE:
        return run
    made = run.decode()
    at = h % len(made)
    return (made[:at] + made[at + 1 :]).encode()


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of whole texts, those of enough code points that occur often enough.

    A document's runs are counted before its words are made, a task's words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = _to_arrow("word string, n long"), Counter()

        def flush():
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], schema=out)

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), utf8(batch), strict=True):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for r, n in _runs(t or b"").items():
                    held[damaged(r, seed)] += n
                if len(held) >= KEPT:
                    yield flush()
                    held = Counter()
        if held:
            yield flush()

    parts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return parts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Spelled:
    """Hashes of a word's prefixes, and of what an edit makes of it, each in constant time."""

    powers = [1]

    def __init__(self, word: str):
        code = list(map(ord, word))
        self.code, self.n = code, len(code)
        self.at = list(accumulate(code, lambda h, c: (h * BASE + c + 1) % PRIME, initial=0))
        while len(self.powers) <= self.n + 1:
            self.powers.append(self.powers[-1] * BASE % PRIME)

    def edited(self, i: int, put: int | None, skip: int) -> int:
        """The hash of the word with `skip` characters from i on replaced by the character `put`, or by nothing."""
        rest = self.n - i - skip
        tail = self.at[self.n] - self.at[i + skip] * self.powers[rest]
        head = self.at[i] if put is None else self.at[i] * BASE + put + 1
        return (head * self.powers[rest] + tail) % PRIME


def _key(h: int) -> bytes:
    return h.to_bytes(16, "big")


_STEP = 65_536  # rows of an output batch, about


def _rows(schema: str, made: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out, held = _to_arrow(schema), []
    for row in made:
        held.append(row)
        if len(held) >= _STEP:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words -> (id, place, node, next): a row a node on a word's path, with the character after it, -1 where it ends."""

    def made():
        for batch in batches:
            for word in batch.column("word").to_pylist():
                s = Spelled(word)
                own = _key(s.at[-1])
                yield from ((own, i, _key(s.at[i]), s.code[i] if i < s.n else -1) for i in range(s.n + 1))

    return _rows("id binary, place int, node binary, next int", made())


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [_key(Spelled(w).at[-1]) for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("word"), batch.column("n")], names=["id", "word", "n"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, lights: place and heavy character of each light branch) -> (key, marked, word, n) of its copies."""

    def made():
        for batch in batches:
            for word, n, lights in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "lights")), strict=True):
                s = Spelled(word)
                for light in lights:
                    i, heavy = light["place"], light["heavy"]
                    if heavy >= 0:
                        yield _key(s.edited(i, heavy, 0)), False, word, n  # the heavy character put in
                    if i == s.n:
                        continue
                    if i + 1 == s.n or s.code[i + 1] != s.code[i]:  # else the pair parts further down
                        yield _key(s.edited(i, None, 1)), False, word, n  # skipped
                    if heavy >= 0:
                        yield _key(s.edited(i, heavy, 1)), False, word, n  # replaced by the heavy one
                    yield _key(s.edited(i, ANY, 1)), True, word, n  # replaced by the mark

    return _rows("key binary, marked boolean, word string, n long", made())


def light_branches(words: DataFrame) -> DataFrame:
    """(id, lights): where the path of each word leaves heavy paths, and by which heavy character it would not.

    Branches are counted with partial sums; only nodes with two branches or more are joined back, hot ones (the root,
    and short prefixes) dealt over tasks. The heavy branch has the most words, of equal ones the lowest character,
    the end (-1) first; so lights holds at most log2(words) + 1 entries."""
    paths = cut(words.select("word").mapInArrow(_paths, "id binary, place int, node binary, next int"), "paths")
    branches = paths.groupBy("node", "next").agg(F.count("*").alias("size"))
    nodes = branches.groupBy("node").agg(F.min(F.struct(-F.col("size"), "next")).getField("next").alias("heavy"), F.count("*").alias("branches"), F.sum("size").alias("rows")).where("branches > 1").drop("branches")
    nodes = cut(nodes, "nodes")
    met = spread_join(paths, nodes, ["node"], paths.count(), "rows", by="id").where("next <> heavy")
    return met.groupBy("id").agg(F.collect_list(F.struct("place", "heavy")).alias("lights"))


def _near(a: str, b: str):
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best: struct of -n and word of the most frequent near word) of words (word, n) that have one.

    Neither pairs nor lists of a word's near words are held: a link found by a copy counts once for both ends; a group
    of k marked copies counts k - 1 for each, and its most frequent member stands for all the others' best, the
    others for its own."""
    held = cut(words.select("word", "n").mapInArrow(_ids, "id binary, word string, n long"), "words")
    copies = cut(held.join(light_branches(held), "id").select("word", "n", "lights").mapInArrow(_copies, "key binary, marked boolean, word string, n long"), "copies")

    other = held.select(F.col("id").alias("key"), F.col("word").alias("other"), F.col("n").alias("m"))
    hits = cut(copies.where("NOT marked").join(other, "key").where(_near("word", "other")).select("word", "n", "other", "m"), "hits")
    rank = lambda n, w: F.struct((-F.col(n)).alias("minus_n"), F.col(w).alias("word"))
    one = hits.select("word", F.lit(1).cast("long").alias("k"), rank("m", "other").alias("best"))
    two = hits.select(F.col("other").alias("word"), F.lit(1).cast("long").alias("k"), rank("n", "word").alias("best"))

    marked = copies.where("marked").select("key", "word", "n")
    groups = marked.groupBy("key").agg(F.min(rank("n", "word")).alias("top"), F.count("*").alias("size")).where("size > 1").withColumn("rows", F.col("size"))
    met = cut(spread_join(marked, groups, ["key"], marked.count(), "rows", by="word"), "marked")
    own = met.select("word", (F.col("size") - 1).alias("k"), F.when(F.col("top.word") != F.col("word"), F.col("top")).alias("best"))
    back = met.where("top.word <> word").select(F.col("top.word").alias("word"), F.lit(0).cast("long").alias("k"), rank("n", "word").alias("best"))
    return one.union(two).union(own).union(back).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, factor: int = FACTOR, most: int = 64) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n).

    form is the near word of the largest n (ties: the smallest in code-point order) if that is `factor` times the word's
    own n or more; root the last word of the chain of forms. n grows with each step of a chain, so chains are
    short, and following them by doubling settles in a few rounds.

    Words come once each; a null word or n takes no part. A very long word is read whole: its path is as many rows as it
    has characters. An empty vocabulary gives no rows. Other columns, whatever their names, are not read."""
    words = cut(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL"), "vocabulary")
    total = words.count()
    near = neighbours(words)
    strong = -F.col("best.minus_n") >= factor * F.col("n")
    made = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.minus_n")).alias("form_n"))
    made = cut(made, "forms")
    # word -> the word it stands at; a step goes from there to where that stands
    now, path = cut_to(made.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(most):
        met = now.groupBy("root").agg(F.count("*").alias("rows"))
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further")).join(met, "root")
        moved = spread_join(now, step, ["root"], total, "rows", by="word").select("word", "further")
        if not moved.limit(1).count():
            break
        after, next_path = cut_to(now.join(moved, "word", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        remove(words.sparkSession, path)
        now, path = after, next_path
    else:
        raise RuntimeError(f"chains of forms did not settle in {most} rounds")
    return made.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("word", "form", "root", "n", "n_near", "form_n")
