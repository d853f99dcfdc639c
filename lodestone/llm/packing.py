"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by rank into shards of a fixed
number of items; each shard is packed by several islands in tasks of their own. An individual is a
grouping of a shard's items into bins. Crossover injects the best-filled bins of one parent whole into
the other, removes the bins that hold any of the same items, and puts the items so displaced back by best
fit, longest first. Between epochs every island's elite individual migrates to the next island (a join on shard and
island). The fittest individual of a shard wins; bins that are not full enough are opened again, and
their items are dealt into new, fewer shards for another round, until one shard holds them all.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, cut, ranked, utf8
from lodestone.llm.tokens import encoder, public_path

CAPACITY, END = 4096, 1
SHARD = 4096  # items of a shard, at most
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 40, 8
ROUNDS = 4
OPEN = 0.995  # bins filled less are opened again between rounds

Bins = list[tuple[int, ...]]  # the items of every bin, ascending


class Spaces:
    """Bins by free space: the smallest space that fits comes from one shift of a bit set."""

    def __init__(self, capacity: int):
        self.bits, self.by = 0, [[] for _ in range(capacity + 1)]

    def add(self, space: int, k: int) -> None:
        self.by[space].append(k)
        self.bits |= 1 << space

    def take(self, length: int) -> int | None:
        """The bin with the least space that `length` fits in, now so much fuller; None if there is none."""
        fit = self.bits >> length
        if not fit:
            return None
        space = length + (fit & -fit).bit_length() - 1
        k = self.by[space].pop()
        if not self.by[space]:
            self.bits ^= 1 << space
        if space > length:
            self.add(space - length, k)
        return k


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: Bins) -> Bins:
    """bins with the items added, in the order given."""
    spaces, bins = Spaces(capacity), list(bins)
    grown: dict[int, list[int]] = {}
    for k, b in enumerate(bins):
        if (space := capacity - sum([lengths[i] for i in b])) > 0:
            spaces.add(space, k)
    for i in items:
        if (k := spaces.take(lengths[i])) is None:
            k = len(bins)
            bins.append(())
            spaces.add(capacity - lengths[i], k)
        grown.setdefault(k, []).append(i)
    for k, more in grown.items():
        bins[k] = tuple(sorted([*bins[k], *more]))
    return bins


def fitness(bins: Bins, lengths: list[int], capacity: int) -> float:
    """Fewer bins first; among as many, the mean square of their fill."""
    return sum([(sum([lengths[i] for i in b]) / capacity) ** 2 for b in bins]) / len(bins) ** 2 - len(bins) if bins else 0.0


def cross(one: Bins, other: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """`one` with some of the well-filled bins of `other` injected whole; bins of `one` that hold any of the same
    items go, and the items so displaced are put back by best fit, longest first. Bins that both parents have
    are left out of the choice: to inject them changes nothing."""
    had = set(one)
    news = [b for b in other if b not in had]
    if not news:
        return one
    news.sort(key=lambda b: (-sum([lengths[i] for i in b]), b))
    best = news[: max(1, (2 * len(news) + 2) // 3)]
    injected = rng.sample(best, rng.randint(1, max(1, len(best) // 2)))
    inside = {i for b in injected for i in b}
    kept = [b for b in one if inside.isdisjoint(b)]
    displaced = [i for b in one if not inside.isdisjoint(b) for i in b if i not in inside]
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(displaced, lengths, capacity, kept + injected)


def mutated(one: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """`one` with its emptiest bin and a few others opened, and their items put back by best fit in a shaken order."""
    order = sorted(range(len(one)), key=lambda k: sum([lengths[i] for i in one[k]]))
    gone = {order[0], *rng.sample(order, min(len(order), rng.randint(1, 4)))}
    items = [i for k in gone for i in one[k]]
    noise = {i: -lengths[i] * rng.uniform(0.7, 1.3) for i in items}
    return best_fit(sorted(items, key=lambda i: (noise[i], i)), lengths, capacity, [b for k, b in enumerate(one) if k not in gone])


def to_bytes(bins: Bins, n: int) -> bytes:
    at = np.zeros(n, "<u2")
    for k, b in enumerate(bins):
        at[list(b)] = k
    return at.tobytes()


def from_bytes(data: bytes) -> Bins:
    at = np.frombuffer(data, "<u2")
    bins: list[list[int]] = [[] for _ in range(int(at.max()) + 1 if len(at) else 0)]
    for i, k in enumerate(at.tolist()):
        bins[k].append(i)
    return list(map(tuple, bins))


def evolve(lengths: list[int], capacity: int, population: list[Bins], guests: list[Bins], seed: int, size: int = POPULATION, generations: int = GENERATIONS) -> list[Bins]:
    """The population after an epoch, the fittest first.

    It starts from best fit by falling length and by shaken lengths. Every generation crosses two parents, the
    fitter of two draws each, sometimes mutates the child, and puts it in the place of the least fit. It ends
    early only where no grouping can have fewer bins: at the total length over the capacity, rounded up, or
    the number of items longer than half a bin."""
    rng = random.Random(seed)
    least = max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))
    population = [*population, *guests]
    if not population:
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        population.append(best_fit(order, lengths, capacity, []))
    while len(population) < size and min(map(len, population)) > least:
        noise = [lengths[i] * rng.uniform(0.8, 1.2) for i in range(len(lengths))]
        population.append(best_fit(sorted(range(len(lengths)), key=lambda i: -noise[i]), lengths, capacity, []))
    scored = sorted(((fitness(b, lengths, capacity), -k, b) for k, b in enumerate(population)), key=lambda x: x[:2], reverse=True)[:size]
    draw = lambda: min(rng.randrange(len(scored)), rng.randrange(len(scored)))
    for g in range(generations):
        if len(scored) < 2 or len(scored[0][2]) <= least:
            break
        child = cross(scored[draw()][2], scored[draw()][2], lengths, capacity, rng)
        if rng.random() < 0.5:
            child = mutated(child, lengths, capacity, rng)
        fit = fitness(child, lengths, capacity)
        if fit > scored[-1][0] and all(fit != x[0] for x in scored):
            scored[-1] = (fit, -len(population) - g, child)
            scored.sort(key=lambda x: x[:2], reverse=True)
    return [b for _, _, b in scored]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END, drops_space: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents encoded, ended, and cut if longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, end = _to_arrow("doc_id long, piece int, start long, length long, ids_crc32 long"), encoder(tokenizer, drops_space, "<u4"), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), own.encode(utf8(b)), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


ITEM = np.dtype([("doc", "<i8"), ("none", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's items, longest first, as one row."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True])
    items = np.zeros(len(pdf), ITEM)
    items["none"] = pdf["doc_id"].isna()
    items["doc"] = pdf["doc_id"].fillna(0).astype("int64")
    for a, b in (("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
        items[a] = pdf[b]
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "items": [items.tobytes()]})


def _epoch(capacity: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow("shard long, island int, lengths binary, population binary, elite binary, score double")
        for b in batches:
            rows = []
            for r in b.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i8").tolist()
                n = 2 * len(lengths)
                own = [from_bytes(r["population"][i : i + n]) for i in range(0, len(r["population"] or b""), n)]
                guests = [from_bytes(r["guest"])] if r["guest"] else []
                after = evolve(lengths, capacity, own, guests, hash((seed, r["shard"], r["island"])))
                rows.append((r["shard"], r["island"], r["lengths"], b"".join(to_bytes(x, len(lengths)) for x in after), to_bytes(after[0], len(lengths)), fitness(after[0], lengths, capacity)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def _placed(capacity: int, round_: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean")
        for b in batches:
            for r in b.to_pylist():
                items, rows = np.frombuffer(r["items"], ITEM), []
                for k, bin_ in enumerate(from_bytes(r["elite"])):
                    closed, at = last or items["length"][list(bin_)].sum() >= OPEN * capacity, 0
                    for i in bin_:
                        x = items[i]
                        rows.append((None if x["none"] else int(x["doc"]), int(x["piece"]), int(x["start"]), int(x["length"]), int(x["crc"]), round_ << 56 | r["shard"] << 13 | k, at, bool(closed)))
                        at += int(x["length"])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, seed: int = 5, shard: int = SHARD) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    No length may exceed capacity; sequences have no gaps. Rows that repeat are separate items. A null
    doc_id is packed like any. An empty table gives no rows."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done: DataFrame | None = None
    for round_ in range(ROUNDS):
        ordered = ranked(items.select(*columns), [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32", "length")], "rank")
        shards = max(1, -(-ordered.count() // shard))
        last = shards == 1 or round_ == ROUNDS - 1
        held = cut(ordered.withColumn("shard", F.pmod("rank", F.lit(shards))).groupBy("shard").applyInPandas(_shard, "shard long, items binary"), "shards")
        now = held.select("shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "items").mapInArrow(_lengths, "shard long, island int, lengths binary")
        now = now.withColumns({"population": F.lit(None).cast("binary"), "guest": F.lit(None).cast("binary")})
        for epoch in range(EPOCHS):
            state = cut(now.repartition(max(8, min(1024, shards * ISLANDS)), "shard", "island").mapInArrow(_epoch(capacity, seed + epoch), "shard long, island int, lengths binary, population binary, elite binary, score double"), "islands")
            guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
            now = state.drop("elite", "score").join(guests, ["shard", "island"])
        best = state.groupBy("shard").agg(F.max_by("elite", F.struct("score", -F.col("island"))).alias("elite"))
        placed = cut(held.join(best, "shard").mapInArrow(_placed(capacity, round_, last), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"), "placed")
        full = placed.where("closed").drop("closed")
        done = full if done is None else done.union(full)
        if last:
            return done
        items = placed.where("NOT closed")
    return done


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _to_arrow("shard long, island int, lengths binary")
    for b in batches:
        lengths = [np.ascontiguousarray(np.frombuffer(x, ITEM)["length"]).tobytes() for x in b.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("island").cast(pa.int32()), pa.array(lengths, pa.binary())], schema=out)


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): documents cut into pieces and packed.

    A null or empty text is a piece of the end id alone; a text of more than `capacity` tokens, however long, is
    cut into pieces. A null doc_id stays null. Rows that repeat a document are packed each by itself. An empty
    table gives no rows. Other columns of docs, whatever their names, are not read."""
    return pack(cut(pieces(docs, tokenizer or public_path("word_bpe_49k.json"), capacity), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
