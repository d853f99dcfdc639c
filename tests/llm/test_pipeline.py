"""The pipeline stage by stage on a small table, each against brute force over the stage's own input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import jaccard_dedup, near_dedup, packing, quality_rules, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, found int, words string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Invented documents with every stage's cases: junk, near copies, shared passages, nulls, repeated ids and rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, texts = prose(70), []
    for i in range(40):
        lines = [prose(rng.randint(60, 160)) for _ in range(rng.randint(1, 3))]
        if i % 5 == 0:
            lines.insert(1, "Home | About | Help | Terms")
        if i % 7 == 0:
            lines.append(passage)
        texts.append("\n".join(lines))
    near = texts[3].split(" ")
    near[10] = "changed"
    texts += [texts[1], " ".join(near), None, "", "too short", "same words here " * 40, "| a | b |\n" * 60, prose(3000), " " + texts[2] + "\t"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None]), len(t or ""), "k", 1, "w") for i, t in enumerate(texts)]
    rows += [rows[4], (5, prose(200) + "\n" + passage, "en", "s2", 9, None, None, None)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def words(text):
    return (text or "").encode().split()


def good_line(line):
    n, chars = len(words(line)), len("".join(line.split(" ")).replace("\t", ""))
    symbols, low = sum(c in quality_rules.SYMBOLS for c in line), line.lower()
    bars = sum(c in quality_rules.BARS for c in line)
    return n == 0 or not (bars * 4 >= n or (symbols >= 3 and symbols * 100 > chars * 4) or (n >= 15 and not any(m in line for m in quality_rules.MARKS)) or (n <= 40 and any(p in low for p in quality_rules.BOILERPLATE)))


def naive_quality(rows):
    out = []
    for doc, text, source in rows:
        w, lines = words(text), (text or "").split("\n")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        clean = "\n".join(x for x in lines if good_line(x))
        size = lambda t: sum(len(x.decode()) for x in words(t))
        if len(w) >= 50 and 2 * len(again) <= len(w) and 2 * (size(text) - size(clean)) <= size(text):
            out.append((doc, clean, source))
    return out


def naive_near(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or 5 * len(a & b) >= 4 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in group}
    gone = {r[0] for r, g in zip(rows, group, strict=True) if least[g] < r[0]}
    return [r for r in rows if r[0] not in gone]


def naive_cut(rows):
    first = {}
    for doc, text, _ in rows:
        w = words(text)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text, source in rows:
        w = words(text)
        gone = {i + k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < doc for k in range(50)}
        if not w or len(gone) < len(w):
            out.append((doc, [x for i, x in enumerate(w) if i not in gone], source))
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def key(r):
    return (r[0], str(r[1]), str(r[2]))


def test_stages_against_brute_force(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], table).cache())
    for df in frames[:-1]:
        assert df.columns == docs.columns
    assert sorted(rows_of(frames[1]), key=key) == sorted(naive_quality(rows_of(docs)), key=key)
    assert sorted(rows_of(frames[2]), key=key) == sorted(naive_near(rows_of(frames[1])), key=key)
    assert len(rows_of(frames[2])) < len(rows_of(frames[1])) < docs.count()
    got = [(d, words(t), s) for d, t, s in rows_of(frames[3])]
    assert sorted(got, key=key) == sorted(naive_cut(rows_of(frames[2])), key=key)
    assert sum(len(w) for _, w, _ in got) < sum(len(words(t)) for _, t, _ in rows_of(frames[2]))

    # the mix: whole documents, at most three times each, and each source's words near its target
    had, mixed = Counter(rows_of(frames[3])), Counter(rows_of(frames[4]))
    assert set(mixed) <= set(had) and all(n <= 3 * had[r] for r, n in mixed.items())
    size = lambda rows, s: sum(n * len(words(t)) for (_, t, src), n in rows.items() if src == s)
    sources = sorted({s for _, _, s in had}, key=lambda s: (s is None, s or ""))
    sizes, weight = {s: size(had, s) for s in sources}, dict(zip(sources, (5, 2, 1), strict=False))
    level, capped = 0.0, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and 3 * sizes[s] < weight[s] * level}
        if not more:
            break
        capped |= more
    for s in sources:
        assert abs(size(mixed, s) - min(3 * sizes[s], weight[s] * level)) <= 60

    # the packing: every document's pieces, and sequences without gaps or overflow
    plain = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    want = Counter()
    for (d, t, _), n in mixed.items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, packing.END]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[(d, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()))] += n
    last = frames[5].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in last) == want
    at = Counter()
    for r in sorted(last, key=lambda r: r["offset"]):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    piece = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.select(*piece).collect()) == sorted(docs.select(*piece).collect())
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_near_duplicates_takes_the_groups_of_fingerprints(spark, monkeypatch):
    """Pairs within 3 bits are candidates of their own, whatever the bands find; the sets still decide."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(500)]
    near = next(t for i in range(100, 400) if (t := base[:i] + ["other"] + base[i + 1 :]) and (near_dedup.fingerprint(" ".join(t).encode()) ^ near_dedup.fingerprint(" ".join(base).encode())).bit_count() <= 3)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[::-1]))], "doc_id long, text string")
    monkeypatch.setattr(jaccard_dedup, "like_links", lambda keys, sketches: spark.createDataFrame([], "a long, b long"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs, similar=(1, 1)).collect()) == [1, 2, 3]
