"""Vector codes, spelling variants and exact duplicates against brute force, and on their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, spelling, vector_codes

SF = "/root/testdata/sf0.001"


# ---- vector codes


@given(st.integers(0, 10_000), st.integers(1, 20), st.integers(1, 9), st.sampled_from([2, 40, 1 << 20, vector_codes.EDGE]))
@settings(max_examples=80, deadline=None)
def test_annuli_find_the_nearest_entry(seed, k, width, reach):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-reach, reach + 1, (k, width)), rng.integers(-reach, reach + 1, (50, width))
    x[:k] = entries[: len(x)]
    index, d = vector_codes.Annuli(entries).nearest(x)
    want = ((x[:, None].astype(object) - entries[None]) ** 2).sum(2)
    assert d.tolist() == want.min(1).tolist()
    assert index.tolist() == [list(w).index(w.min()) for w in want]


def test_annuli_leave_entries_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-9, 10, (16, 8)) * np.arange(1, 17)[:, None] * 40
    search = vector_codes.Annuli(entries)
    x = entries[rng.integers(0, 16, 4000)] + rng.integers(-20, 21, (4000, 8))
    search.nearest(x)
    assert search.weighed < 0.5 * 16 * len(x)


def naive_codes(rows, parts=8, entries=16, rounds=6):
    """(codes and errors in the order of rows, codebooks) of integer rows (id, x), without pruning."""
    dims = max((len(x) for _, x in rows), default=0)
    width = max(1, -(-dims // parts))
    data = np.array([list(x) + [0] * (parts * width - len(x)) for _, x in rows], dtype=np.int64).reshape(len(rows), parts * width)
    first = {}
    for (i, x), row in zip(rows, data, strict=True):
        if i is not None and (i not in first or list(x) < first[i][0]):
            first[i] = (list(x), row)
    start = np.array([first[i][1] for i in sorted(first)[:entries]])
    codes, errors, books = [], 0, []
    for p in range(parts):
        own, book = data[:, p * width : (p + 1) * width], start[:, p * width : (p + 1) * width].copy()
        for r in range(rounds + 1):
            d = ((own[:, None] - book[None]) ** 2).sum(2)
            at = d.argmin(1)
            if r < rounds:
                for e in range(len(book)):
                    if (at == e).any():
                        book[e] = own[at == e].sum(0) // (at == e).sum()
        codes.append(at)
        errors = errors + d.min(1)
        books.append(book)
    return ["".join(f"{c:02x}" for c in row) for row in np.array(codes).T], list(errors), books


VECTORS = "vec_id long, embedding array<float>, label string, x string, n int, code string, row int, key string"


def test_vector_codes(spark):
    rng = random.Random(3)
    vec = lambda n: [rng.choice([rng.gauss(0, 1), 0.0, -0.25]) for _ in range(n)]
    rows = [(rng.randrange(90), vec(rng.choice([20, 20, 20, 17, 3, 0])), rng.choice(["a", "a", "b", None]), "z", 1, "c", 2, "k") for _ in range(150)]
    rows += [rows[5], rows[5], (None, vec(20), "b", *rows[0][3:]), (7, None, "a", *rows[0][3:]), (1, [None, 1.0], "a", *rows[0][3:]), (2, [float("nan")], "a", *rows[0][3:]), (3, [float("inf")], None, *rows[0][3:]), (4, [1e30, -1e30], "a", *rows[0][3:])]
    df = vector_codes.quantised(spark.createDataFrame(rows, VECTORS).repartition(3))
    got, books = vector_codes.compress(df)
    got = vector_codes.with_label_error(got).collect()
    held = [(r["vec_id"], r["x"], r["label"]) for r in df.collect()]
    assert len(held) == 154 and max(max(x, default=0) for _, x, _ in held) == vector_codes.EDGE
    codes, errors, want = naive_codes([(i, x) for i, x, _ in held])
    assert vector_codes.digest(books) == vector_codes.digest(want)
    by = Counter()
    for (_, _, label), e in zip(held, errors, strict=True):
        by[label] += int(e)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=key) == sorted(((i, c, int(e), by[label]) for (i, _, label), c, e in zip(held, codes, errors, strict=True)), key=key)


def test_vector_codes_of_few_or_no_vectors(spark):
    one = spark.createDataFrame([(5, [0.5, -0.5], "a", "z", 1, "c", 2, "k")], VECTORS)
    made, books = vector_codes.compress(vector_codes.quantised(one))
    r = made.first()
    assert (r["code"], r["error"]) == ("00" * 8, 0) and vector_codes.decode(r["code"], books)[:2].tolist() == [2048, -2048]
    for rows in ([], [(None, [0.5], "a", "z", 1, "c", 2, "k")]):
        assert vector_codes.with_label_error(vector_codes.compress(vector_codes.quantised(spark.createDataFrame(rows, VECTORS)))[0]).collect() == []


# ---- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive_variants(words):
    form, near = {}, {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        near[w] = len(others)
        form[w] = min(others)[1] if others and -min(others)[0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(spark, words):
    rows = [(w, n, "k", "t", 1, "r") for w, n in words.items()]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long, key string, top string, size int, root string").repartition(3))
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect())


@pytest.mark.parametrize("letters, longest, seed", [("ab", 7, 1), ("abcé", 5, 2), ("a", 30, 3)])
def test_variants_of_dense_vocabularies(spark, letters, longest, seed):
    """Short words of few letters: every node branches, and words have near words by each kind of edit, many of them."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.choice([1, 2, 3, 4, 8, 16, 33, 70]) for _ in range(180)}
    assert variants_of(spark, words) == naive_variants(words)


def test_variants_of_hot_and_long_words(spark):
    long = "xyz" * 3000
    words = {long: 9, long[:-1]: 4, long[:4000] + "q" + long[4001:]: 2, long[1:]: 1}
    words |= {"kernel" + chr(97 + i): 3 + i for i in range(26)} | {"kernel": 5, "colour": 100, "color": 40, "colr": 3, "kernelxy": 1}
    assert variants_of(spark, words) == naive_variants(words)
    assert variants_of(spark, {}) == []
    null = spark.createDataFrame([(None, 3), ("alone", None), ("words", 4)], "word string, n long")
    assert [r["word"] for r in spelling.variants(null).collect()] == ["words"]


def naive_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_counted_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aAbéÀÿ×") for _ in range(rng.randint(3, 6)))
    vocabulary = [word() for _ in range(60)]
    rows = [(i, rng.choice([" ", ", ", "1", "ł"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(None, " ".join(vocabulary * 5)), (3, None), (4, ""), rows[9], (9, "Straße " * 50_000), (10, "x" * 100_000 + " " + "x" * 100_000 + " " + "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert {r["word"]: r["n"] for r in spelling.counted(docs).collect()} == naive_words(rows)


def test_spelling_variants_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.op12_spelling_variants(spark, SF).collect())
    assert got == naive_variants(naive_words(docs))
    assert any(r[1] for r in got)


# ---- exact duplicates


@given(st.sets(st.integers(0, 1 << 40), max_size=60), st.integers(0, 1 << 20))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values, low):
    v = np.array(sorted(values), np.uint64) + np.uint64(low)
    assert exact_dedup.ungolomb(exact_dedup.golomb(v, low), len(v), low).tolist() == v.tolist()


def test_golomb_is_small():
    v = np.unique(np.random.default_rng(2).integers(0, 1 << 30, 10_000).astype(np.uint64))
    assert len(exact_dedup.golomb(v, 0)) * 8 < 18.5 * len(v)  # about log2(2 ** 30 / 10,000) + 1.5 bits each, not 30


def naive_same(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups, out, kept = {}, [], set()
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        ids = [x for x in groups[low(t)] if x is not None]
        first = low(t) not in kept
        kept.add(low(t))
        out.append((i, max(ids, default=None), len(groups[low(t)]), first, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("owner_rows, spare", [(1 << 23, 8), (64, 0)])
def test_same_texts(spark, monkeypatch, owner_rows, spare):
    """With spare 0 about half of the unique texts share a fingerprint and must be told apart by their bytes."""
    monkeypatch.setattr(exact_dedup, "SPARE", spare)
    rng = random.Random(6)
    rows = [(i, f"text {rng.randrange(900)}") for i in range(1500)] + [(i, "Copies Of One") for i in range(1500, 2300)]
    rows += [(5000, "ÀB"), (5001, "Àb"), (5002, "àb"), (5003, None), (5004, ""), (5005, " "), (5006, "x" * 300_000), (5007, "X" * 300_000), (None, "copies of one"), (None, "only null"), (None, "Only Null"), (5000, "ÀB"), (5000, "other")]
    docs = spark.createDataFrame([(*r, "s", 1, "k", True) for r in rows], "doc_id long, text string, sha string, row int, chunk string, suspect boolean").repartition(5)
    got = exact_dedup.same_texts(docs, owner_rows=owner_rows).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: tuple((v is None, v or 0) for v in r)) == naive_same(rows)


def test_same_texts_hot_row_and_empty(spark):
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("Same").alias("text"))
    r = exact_dedup.same_texts(hot.union(spark.createDataFrame([(8, "else")], "doc_id long, text string"))).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(tuple(x) for x in r) == [(7, 7, 100_000, False, 99_999), (7, 7, 100_000, True, 1), (8, 8, 1, True, 1)]
    assert exact_dedup.same_texts(hot.limit(0)).collect() == []


def test_texts_are_not_shuffled_but_suspects(spark):
    """The table of texts is joined with bitmaps where it lies: no exchange above it carries a text that is not a suspect's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = exact_dedup.exchange(docs, docs.count())._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(above) >= 1 and all("chunk" in line and "text" not in line for line in above)
