"""The operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import exact_topk, html_extract, jaccard_dedup, language_id, mixing, near_dedup, packing, quality_rules, substring_dedup, token_files, tokens, warc
from lodestone.llm.shared import components, scratch, spread_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, size string, found int, words string, copy double"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, base = prose(80), prose(300)
    texts = [base, base, base.replace(" a", " b", 1), passage + " " + prose(40), prose(30) + "\n" + passage, prose(60) + " " + passage + " " + prose(9), None, "", " \n\t ", "one", "x " * 70, prose(20000), "same words here " * 30, passage, prose(200) + "\nHome | About | Help | Terms\n" + prose(90), "•", "é", base.upper()]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s1")[i % 4], len(t or ""), "k", 1, "z", 2, "w", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], (None, passage, "en", "s1", 1, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def words_of(text):
    return (text or "").encode().split()


def naive_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_groups(spark, docs):
    got = rows_of(near_dedup.near_groups(docs), "doc_id", "fingerprint", "component_id")
    data = rows_of(docs, "doc_id", "text")
    fps = [naive_print(t) for _, t in data]
    assert sorted((d if d is not None else -1, f) for d, f, _ in got) == sorted((d if d is not None else -1, f"{f:016x}") for (d, _), f in zip(data, fps, strict=True))
    group = list(range(len(data)))
    for _ in data:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    want = {}
    for g, (d, _) in zip(group, data, strict=True):
        if d is not None:
            want[g] = min(want.get(g, d), d)
    assert sorted((d, c) for d, _, c in got if d is not None) == sorted((d, want[g]) for g, (d, _) in zip(group, data, strict=True) if d is not None)
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
    kept = rows_of(near_dedup.keep_one(docs), "doc_id")
    assert (0,) in kept and (1,) not in kept and kept.count((3,)) == 2


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chain_finds_every_pair_within_three_bits(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    near = (a ^ b).bit_count() <= 3
    found = False
    for i in range(4):
        masks = near_dedup._chain_masks((i * 6) << 32)
        if not (a ^ b) >> 16 * i & 0xFFFF:
            found |= len(near_dedup.linked(np.uint64(a), np.array([b], np.uint64), masks)) == 1
    assert found == near


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_by_jaccard(spark):
    """Copies with edited words on both sides of 0.8, far beyond three bits of a fingerprint, and a chain of them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        texts.append(base)
        for _ in range(5):
            w = list(rng.choice(texts[-3:]))
            for k in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.005, 0.015, 0.02, 0.03, 0.04])))):
                w[k] = word()
            texts.append(w)
    data = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(100, ""), (101, None), (102, "a b"), (103, "A  b"), (104, "a c"), (0, "other words under a used id"), (105, "Other words under a used id"), (None, " ".join(texts[1]))]
    sets, group = [five_words(t) for _, t in data], list(range(len(data)))
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    between = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if alike(a, b)]
    assert sum(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in between) > 10
    for _ in data:
        for i, j in between:
            group[i] = group[j] = min(group[i], group[j])
    least = {g: min(d for h, (d, _) in zip(group, data, strict=True) if h == g and d is not None) for g in group}
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = rows_of(jaccard_dedup.similar_groups(df), "doc_id", "component_id")
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(got, key=key) == sorted(((d, least[g]) for g, (d, _) in zip(group, data, strict=True)), key=key)
    gone = {d for (d, _), g in zip(data, group, strict=True) if d is not None and least[g] < d}
    assert sorted(rows_of(near_dedup.keep_one(df.where("doc_id IS NOT NULL")), "doc_id")) == sorted((d,) for d, _ in data if d is not None and d not in gone)


def template_pages(n=400, seed=9):
    """Texts that share a template of 300 words and differ in 110 of their own: similarities of about 0.57."""
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    head, foot = words(150), words(150)
    return [f"{head} {words(110)} {foot}" for _ in range(n)]


def test_template_pages_do_not_chain(spark, monkeypatch):
    """Pages of one template, below the bound, share keys by chance; sketches keep them from becoming one group."""
    texts = template_pages()
    sets = [set(jaccard_dedup.shingles(t.encode()).tolist()) for t in texts]
    assert 0.5 < np.mean([len(a & b) / len(a | b) for a, b in zip(sets, sets[1:], strict=False)]) < 0.6
    rows = [(i, *jaccard_dedup.band_keys(jaccard_dedup.shingles(t.encode()))) for i, t in enumerate(texts)]
    held = spark.createDataFrame([(i, k.tolist(), s) for i, k, s in rows], "node long, keys array<long>, sketch binary")
    keys = held.select("node", F.explode("keys").alias("key"))
    chained = components(keys.alias("a").join(keys.alias("b"), "key").where("a.node < b.node").select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    assert chained.groupBy("root").count().agg(F.max("count")).first()[0] > 100  # what keys alone make of them
    links = jaccard_dedup.like_links(keys, held.select("node", "sketch"))
    groups = components(links).groupBy("root").count().agg(F.max("count")).first()[0]
    assert (groups or 0) < 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[7].replace("w", "v", 1)])], "doc_id long, text string")
    got = dict(rows_of(jaccard_dedup.similar_groups(df), "doc_id", "component_id"))
    assert got == {i: i for i in range(400)} | {400: 7}


def test_recall_of_similar_pairs(spark):
    """Measured against exact pairs over the documents of sf0.01 and edited copies of theirs, of similarities just above
    0.8: at least 0.99 of the pairs of 0.8 or more are in one group."""
    rng = random.Random(2)
    data = rows_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IS NOT NULL"), "doc_id", "text")
    for i, t in data[:]:
        w = (t or "").split()
        if 60 <= len(w) <= 1500:
            for at in rng.sample(range(len(w)), max(1, round(len(w) * 0.019))):
                w[at] = f"edit{at}"
            data.append((100_000 + i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    classes = {}
    for d, t in data:
        s = jaccard_dedup.shingles((t or "").encode())
        if len(s):
            classes.setdefault(s.tobytes(), (s, []))[1].append(d)
    sets, ids = [s for s, _ in classes.values()], [d for _, d in classes.values()]
    owners = {}
    for i, s in enumerate(sets):
        for v in s.tolist():
            owners.setdefault(v, []).append(i)
    pairs = []
    for i, s in enumerate(sets):
        both = np.bincount(np.concatenate([owners[v] for v in s.tolist()]), minlength=len(sets))
        pairs += [(ids[i][0], ids[j][0]) for j in np.flatnonzero(5 * both >= 4 * (len(s) + np.array([len(x) for x in sets]) - both)) if j > i]
    group = dict(rows_of(jaccard_dedup.similar_groups(docs), "doc_id", "component_id"))
    found = sum(group[a] == group[b] for a, b in pairs)
    print(f"recall {found} of {len(pairs)} pairs")
    assert len(pairs) > 400 and found >= 0.99 * len(pairs)


def test_similar_groups_hot_row(spark):
    """One row 20,000 times, and one doc_id under other texts: a group's set is made once a task, not once a row."""
    text = " ".join(f"w{i}" for i in range(200))
    hot = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    more = spark.createDataFrame([(5, "other text altogether of seven words here"), (6, text.replace("w7 ", "v7 ")), (7, "other text altogether of seven words here")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]): r["count"] for r in jaccard_dedup.similar_groups(hot.union(more)).groupBy("doc_id", "component_id").count().collect()}
    assert got == {(5, 5): 20_001, (6, 5): 1, (7, 5): 1}


def test_similar_links_across_cells(spark):
    """A crowd of near copies, dealt into many cells, stays one component; a text apart stays out."""
    base = list(range(1, 201))
    sets = [sorted([*base[:i], *base[i + 5 :], 1000 + i]) for i in range(60)] + [list(range(150, 350))]
    rows = [(7, i, len(s), np.array(s, np.uint64).tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "root long, node long, n long, found binary")
    got = components(jaccard_dedup.similar_links(df, cell=900)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(i, 0) for i in range(1, 60)]


def test_class_links_across_cells(spark):
    """A crowd of fingerprints around one, dealt into cells of four, stays one component."""
    rng = random.Random(1)
    fps = {0} | {sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(60)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))], "fp long, rep long")
    got = components(near_dedup.class_links(df, cell=4)).select("root").distinct().collect()
    assert [r["root"] for r in got] == [0]


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert components(edges).agg(F.max("root"), F.count("*")).first()[:] == (0, 200)
    assert components(edges.limit(0)).count() == 0


def test_components_of_a_star_in_no_one_task(spark):
    """A hub's neighbours are dealt: with broadcasts off no step gives one task most of the rows."""
    edges = spark.range(1, 4000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    near = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in spread_join(near, least, ["u"], 8000, by="v").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 7998 and max(sizes) < 2 * sum(sizes) / 4
    assert components(edges).agg(F.max("root"), F.count("*")).first()[:] == (0, 3999)


def test_language(spark, docs):
    en, de = ("the cat sat on the mat and then the dog " * 9), ("der hund und die katze schlafen auf der matte " * 9)
    train = spark.createDataFrame([(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(40)], "key long, text string, lang string")
    model = language_id.learned(train)
    both = spark.createDataFrame([(1, en), (2, de), (3, en + de + de), (4, None), (5, "12 34"), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predicted(both, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "de", "und", "und", "und"]
    assert 0.5 < got[3]["score"] < 0.8 and "en:" in got[3]["mixture"] and got[4]["score"] == 0
    assert language_id.predicted(docs, model).count() == docs.count()
    assert {r["lang_pred"] for r in language_id.predicted(docs, language_id.learned(train.limit(0))).collect()} == {"und"}


def naive_language(names, logs, text):
    """Proportions by expectation-maximisation and penalised selection, gram by gram."""
    raw = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()) + b" "
    grams: dict = {}
    for i in range(len(raw) - 2):
        if raw[i + 1 : i + 3] != b"  ":
            code = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32) >> 17
            grams[code] = grams.get(code, 0) + 1
    if not grams or not any(c.isalpha() for c in text) or not names:
        return "und", 0.0

    def fit(ks):
        w = [1 / len(ks)] * len(ks)
        for _ in range(language_id.ROUNDS if len(ks) > 1 else 0):
            new = [0.0] * len(ks)
            for g, n in grams.items():
                p = [w[j] * math.exp(float(logs[k][g])) for j, k in enumerate(ks)]
                for j in range(len(ks)):
                    new[j] += n * p[j] / sum(p)
            w = [x / sum(new) for x in new]
        return w, sum(n * math.log(sum(w[j] * math.exp(float(logs[k][g])) for j, k in enumerate(ks))) for g, n in grams.items())

    every = list(range(len(names)))
    share = fit(every)[0]
    single = max(every, key=lambda k: (sum(n * float(logs[k][g]) for g, n in grams.items()), -k))
    order = [single, *sorted((k for k in every if k != single), key=lambda k: (-share[k], k))]
    chosen, (w, best) = [single], fit([single])
    for k in order[1:]:
        w_more, gain = fit([*chosen, k])
        if gain - best <= language_id.PENALTY * math.log(sum(grams.values()) + 1):
            break
        chosen, w, best = [*chosen, k], w_more, gain
    top = max(range(len(chosen)), key=lambda j: (w[j], -j))
    return names[chosen[top]], min(1.0, w[top])


def test_language_against_naive_inference(spark):
    """The query's own model on the query's own table, every row inferred again gram by gram."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    train = rows.where(~language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names, logs = language_id.learned(train.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = {r["doc_id"]: r for r in language_id.op2_language_id(spark, sf).collect()}
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    assert len(got) == len(texts)
    mixed = [t[:400] for _, t in texts[:40] if t]
    extra = [(10_000 + i, a + " " + b) for i, (a, b) in enumerate(zip(mixed, mixed[1:], strict=False))]
    found = {r["doc_id"]: r for r in language_id.predicted(spark.createDataFrame(extra, "doc_id long, text string"), (names, logs)).collect()}
    for doc, text in [(d, t) for d, t in texts if len(t or "") < 3000] + extra:
        lang, score = naive_language(names, logs, text)
        r = got.get(doc) or found[doc]
        assert (r["lang_pred"], pytest.approx(score, abs=1e-6)) == (lang, r["score"])
    assert any(" " in r["mixture"] for r in found.values())


def test_many_languages(spark):
    """No bound on the number of languages: 150 of them, a word each."""
    names = [f"l{i:03d}" for i in range(150)]
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i * 7919 % 1000:03d}") * 3
    train = spark.createDataFrame([(i, " ".join([word(i)] * 30), n) for i, n in enumerate(names)] + [(999, "x", None)], "key long, text string, lang string")
    model = language_id.learned(train)
    assert model[0] == names
    got = language_id.predicted(spark.createDataFrame([(i, " ".join([word(i)] * 9)) for i in range(150)], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == dict(enumerate(names))


def test_language_held_out_accuracy(spark):
    out = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 8193, 40000):
        body = bytes(i % 256 for i in range(n))
        assert warc.unchunked(warc.chunked(body)) == body
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_round_trip(spark):
    big, same = "é<p>\r\n\r\n" * 30000, "y" * 200
    data = [(1, "u", same, 0), (2, None, same, 0), (3, "u\r\nx", big, 0), (4, "u", None, 0), (5, "u", "", 0), (6, "u", "short", 0), (7, "u", "short", 0), (2, None, same, 0), (None, "u", same, 0), (8, "u", big, 0)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, digest int")
    path = warc.write_archives(pages, scratch(spark, "t"), segment=1000)
    got = warc.payloads(warc.reassembled(warc.read_records(spark, path))).collect()
    assert len(got) == len(data)
    for r in got:
        want = next(d[2] or "" for d in data if d[0] == r["page_id"])
        assert (r["kind"] == "revisit") == (r["page_id"] in (2, None, 8))
        assert r["payload"] is None if r["kind"] == "revisit" else r["payload"] == want.encode()
        assert r["refers"] == {2: 1, None: 1, 8: 3}.get(r["page_id"])
    assert warc.read_records(spark, warc.write_archives(pages.limit(0), scratch(spark, "t"))).count() == 0


def test_warc_repeated_page_ids(spark):
    """A page_id that repeats with other payloads: each revisit gets the payload that it is a copy of."""
    x, y, z = "x" * 150, "y" * 250, "z" * 5000
    data = [(1, "a", x), (1, "b", y), (2, "c", y), (3, None, x), (3, "c", z), (4, "d", z), (4, "d", z), (None, "e", y), (5, "f", None), (1, "a", x)]
    pages = spark.createDataFrame([(*d, "k", 1) for d in data], "page_id long, url string, html string, digest string, n int")
    path = warc.write_archives(pages, scratch(spark, "t"), segment=1000)
    want = []
    for page, _, html in data:
        body = (html or "").encode()
        first = min((p for p, _, h in data if h == html and p is not None), default=None) if len(body) >= 100 else None
        kind = "response" if first in (None, page) else "revisit"
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), kind, first if kind == "revisit" else None))
    assert sorted(map(tuple, warc.digests(spark, path).collect()), key=str) == sorted(want, key=str)
    heads = [h for r in spark.read.format("binaryFile").load(path).collect() for h, _ in warc.parsed(warc.unzipped(bytes(r["content"])))]
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 5 and all(h["warc-payload-digest"].startswith("sha256:") and h["warc-refers-to-target-uri"] for h in revisits)
    assert warc.digests(spark, warc.write_archives(pages.limit(0), scratch(spark, "t"))).count() == 0


def test_wrong_digest_fails(spark):
    held = warc.read_records(spark, warc.write_archives(spark.createDataFrame([(1, "u", "z" * 500)], "page_id long, url string, html string"), scratch(spark, "t")))
    with pytest.raises(Exception, match="digest"):
        warc.payloads(held.withColumn("digest", F.lit("0" * 64))).collect()


def test_missing_segment_fails(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 5000)], "page_id long, url string, html string")
    held = warc.read_records(spark, warc.write_archives(pages, scratch(spark, "t"), segment=1000))
    with pytest.raises(Exception, match="segments"):
        warc.reassembled(held.where("number <> 2")).collect()


def test_topk(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), [float(v) for v in rng.integers(-3, 4, 5) / 4]) for i in range(300)] + [(7, [0.5] * 5), (900, None), (901, [1.0, float("nan"), 0.0, 0.0, 0.0]), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, []), (None, [1.0] * 5)]
    df = exact_topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = rows_of(exact_topk.search(df, df.where("vec_id % 50 = 0"), 4), "query_id", "rank", "vec_id", "score")
    x = [(i, [int(np.floor(1024 * v)) for v in e]) for i, e in data if i is not None and i not in (900, 901, 902)]
    want = []
    for q, e in x:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), i) for i, f in x if i != q)[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert exact_topk.search(df.limit(0), df).count() == 0


def naive_quality(text):
    t = text or ""
    w = words_of(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)} if len(w) < 2000 else set()
    lines = [x for x in t.split("\n") if x.split()]
    return len(w), len("".join(t.split(" ")).replace("\n", "").replace("\t", "")), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).select("doc_id", "text", "__found.*").collect() if r["doc_id"] is not None}
    for r in got.values():
        if len(r["text"] or "") < 10000:
            assert tuple(r["base"]) == naive_quality(r["text"])
    assert not got[6]["kept"] and got[6]["base"]["n_words"] == 0 and not got[10]["kept"] and got[0]["kept"]
    assert got[14]["kept"] and "Home |" not in got[14]["clean"] and got[14]["lost_chars"] > 0
    clean = quality_rules.keep_good(docs)
    assert clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == 0
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_quality_line_rules(spark):
    bad = ["Home | About | Help", "a b $$ ## %% c", "All rights reserved.", " ".join(["word"] * 15), "» next"]
    good = ["Profit rose 5%.", "It costs $5.", "# Results", "", "  ", " ".join(["शब्द"] * 15) + "।", " ".join(["لفظ"] * 15) + "۔", "short line"]
    made = spark.createDataFrame([(bad + good,)], "x array<string>").select(quality_rules.clean_lines(F.col("x")).alias("x")).first()["x"]
    assert made == good


def test_html():
    model = html_extract.trained()
    page = "<html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class=\"ad\">Buy this thing now.</div><article><h1>A &amp; B head</h1><p>The first  long\nparagraph, with <b>bold</b> words in it, ends here.<p>Another one follows the first, unclosed, and ends here too.</article><footer>&copy; site &middot; Words about us.</footer></body></html>"
    text = html_extract.extract([page, None, "", "no markup at all", "<p><div></b>"], model)
    assert text[0] == "A & B head\nThe first long paragraph, with bold words in it, ends here.\nAnother one follows the first, unclosed, and ends here too."
    assert text[1:3] == ["", ""]


MAIN = "The first long paragraph, with some words in it, ends here, and it goes on for a while."


@pytest.mark.parametrize("start", ["<body>", "", "<noscript><a href=/x>no scripts<body>"])
def test_html_head_left_open(start):
    """A page may leave out </head>, and <body> with it."""
    page = f"<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8>\n<style>p{{}}</style>{start}<article><h1>A head</h1><p>{MAIN}<p>{MAIN}</article></html>"
    assert html_extract.extract([page], html_extract.trained()) == [f"A head\n{MAIN}\n{MAIN}"]


def test_html_head_ends_at_text():
    root = html_extract.parse("<head><title>T</title> \n<script>x</script>Words <b>here</b></head><p>More")
    nodes, _, _ = html_extract.features(root)
    assert html_extract.blocks(nodes, np.ones(len(nodes), bool)) == ["Words here", "More"]


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'title="the hidden cost"', "data-hidden=1", "title='display:none'", "style='display:none;display:block'"])
def test_html_shown_whatever_speaks_of_hidden(attrs):
    page = f"<html><head><title>T</title></head><body><article {attrs}><h1>A head</h1><p>{MAIN}<p>{MAIN}</article></body></html>"
    assert html_extract.extract([page], html_extract.trained()) == [f"A head\n{MAIN}\n{MAIN}"]


@pytest.mark.parametrize("attrs", ["hidden", 'class="x"hidden=""', "HIDDEN=until-found", "aria-hidden=true", "style='color:red; DISPLAY : none !important'", 'style="visibility:hidden"'])
def test_html_hidden(attrs):
    page = f"<html><head><title>T</title></head><body><article><h1>A head</h1><p>{MAIN}<p {attrs}>{MAIN}</article></body></html>"
    assert html_extract.extract([page], html_extract.trained()) == [f"A head\n{MAIN}"]


PAGES = [
    # unquoted attributes, one with an apostrophe in its value
    (f"<html><body><div class=nav><a href=/a>Home</a> <a href=/b>News</a></div><div id=content><h1>Head</h1><p title=it's>{MAIN} We don't stop here.</p><p class=lead data-x=a/b>{MAIN}</p></div></body></html>", f"Head\n{MAIN} We don't stop here.\n{MAIN}"),
    # utility classes
    (f'<body class="flex"><header class="flex p-4"><nav class="flex"><a href="/">Home</a><a href="/x">Blog</a></nav></header><main class="flex-1 overflow-hidden"><article class="prose content overflow-hidden" data-state="not hidden"><h1 class="text-2xl">Head</h1><p class="mt-4 truncate">{MAIN}</p><p>{MAIN}</p></article></main><footer class="p-4"><p>&copy; 2024 Site</p></footer></body>', f"Head\n{MAIN}\n{MAIN}"),
    # an article within an article's section, a quotation and a list
    (f"<article><h1>Head</h1><p>{MAIN}</p><section><h2>Part</h2><p>{MAIN}</p><article><p>{MAIN} Inner.</p><p>{MAIN}</p></article></section><p>{MAIN}</p><blockquote><p>{MAIN}</p></blockquote><ul><li>{MAIN}</li><li>{MAIN}</li></ul></article>", f"Head\n{MAIN}\nPart\n{MAIN}\n{MAIN} Inner.\n{MAIN}\n{MAIN}\n{MAIN}\n{MAIN}\n{MAIN}"),
    # a table of rows without end tags
    (f"<body><article><h1>Head</h1><p>{MAIN}</p><table><tr><td>Cell one</td><td>Cell two<tr><td>Cell three<td>Cell four</table><p>{MAIN}</article></body>", f"Head\n{MAIN}\nCell one\nCell two\nCell three\nCell four\n{MAIN}"),
    # unclosed inline markup, stray end tags, entities, a comment and a script in the text
    (f"<article><h1>A &lt;b&gt; &amp; c</h1></span><p><b>{MAIN}<p>x &eacute; &#233;{MAIN}</div><!-- <p>no</p> --><script>document.write('<p>no</p>')</script><p>{MAIN}</article>", f"A <b> & c\n{MAIN}\nx é é{MAIN}\n{MAIN}"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_html_pages_by_hand(page, want):
    assert html_extract.extract([page], html_extract.trained()) == [want]


def framed():
    """Pages as themes and servers make them: names and forms around everything, links within the article, comments."""
    text = "The quick brown fox jumps over the lazy dog, and then it rests for a while. It was a long day, after all! Nobody saw it go, but many heard of it later. What it did there is not known, though some say it slept. The end of the story is near, and so is the night."
    nav, art, want = "<nav><a href=/>Home</a></nav>", f"<h1>A head</h1><p>{text}</p><p>{text}</p>", f"A head\n{text}\n{text}"
    entries = "".join(f"<li><a href=/x{i}>A thing to read about item {i}</a></li>" for i in range(4))
    listed = "\n".join(f"A thing to read about item {i}" for i in range(4))
    for name in ("sidebar", "sidebar-right", "has-menu", "modal-open", "comments-open", "sidebarright", "single-post logged-in"):
        yield f"<html><head><title>T</title></head><body class='{name}'>{nav}<article class=post>{art}</article><footer>&copy; Site</footer></body></html>", want
    yield f"<html><body><div class='header-fixed'>{nav}<article class=post>{art}</article></div></body></html>", want
    yield f"<html><body><form action=x method=post>{nav}<article class=post>{art}</article></form></body></html>", want
    yield f"<html><body><form id=aspnetForm><div class=nav>{nav}</div><div id=content>{art}</div><div class=footer>Words of us.</div></form></body></html>", want
    yield f"<html><body>{nav}<article class=post><h1>A head</h1><p>{text}</p><ul>{entries}</ul><p>{text}</p></article></body></html>", f"A head\n{text}\n{listed}\n{text}"
    yield f"<html><body><main><h1>A head</h1><p>{text}</p><h2>Sources</h2><ol>{entries}</ol></main><footer>&copy; x</footer></body></html>", f"A head\n{text}\nSources\n{listed}"
    yield f"<html><body class='menu-open popup'><div id=page-header-wrap class='has-sidebar header-top'>{nav}<article><h2>A head</h2><p>{text}</p><p>{text}</p></article><aside class=sidebar><h3>More</h3><ul>{entries}</ul></aside></div></body></html>", want
    said = "".join(f"<article class=comment><p>Ann</p><p>{text[:150]}</p></article>" for _ in range(6))
    yield f"<html><body class=comments-open><article class=post><h1>A head</h1><p>{text}</p></article><section class=comments id=comments><h3>Six replies</h3>{said}</section></body></html>", f"A head\n{text}"
    said = "".join(f"<div class=comment><p>{text}</p></div>" for _ in range(12))
    yield f"<html><body><div class='wrap comments-open widget-area'><article><h1>A head</h1><p>{text}</p></article><div id=comments class=comments>{said}</div></div></body></html>", f"A head\n{text}"
    yield f"<html><body><div class='modal-open login-page'><div class=nav>{nav}</div><div class=entry-content><h2>A head</h2><p>{text}</p><p>{text}</p></div><div class='share social'><li><a href=/a>Tweet</a></li><li><a href=/b>Post</a></li></div></div></body></html>", want
    yield f"<html><body class='with-header-overlay'><article><header class=entry-header><h1>A head</h1></header><div class=entry-content><p>{text}</p><p>{text}</p></div></article></body></html>", want
    yield f"<html><body class=toc-nav><table class=layout-menu><tr><td class=sidebar><ul>{entries}</ul></td><td class=content>{art}</td></tr></table></body></html>", want
    yield f"<html><body><section class='widget-area sidebar-layout'><main>{art}</main><footer class=footer>All rights.</footer></section></body></html>", want


@pytest.mark.parametrize(("page", "want"), list(framed()))
def test_html_frames_are_plain(page, want):
    assert html_extract.extract([page], html_extract.trained()) == [want]


def test_html_attributes():
    """Quotes count where a value starts, and nowhere else; a quote left open ends with its tag."""
    read = lambda source: ["".join(p for p in n.pieces if isinstance(p, str)) for n in html_extract.features(html_extract.parse(source))[0][1:]]
    assert read("<p a=it's b>one</p><p c=d'>two</p>") == ["one", "two"]
    assert read('<p a="x > y" b=\'> "\'>one</p><p "x\'>two</p>') == ["one", "two"]
    assert read('<p a="open>one</p><p>two</p>') == ["one", "two"]
    assert read("<p a = 'x' / b= c>one<p/x>two") == ["one", "two"]


def test_html_generated_pages():
    """Pages of the generator that the model has not seen."""
    model, rng, scores = html_extract.trained(), random.Random(77), []
    for _ in range(60):
        source, mark = html_extract.generated(rng)
        nodes, _, _ = html_extract.features(html_extract.parse(source))
        want = {b.replace(mark, "") for b in html_extract.blocks(nodes, np.ones(len(nodes), bool)) if mark in b}
        got = set(html_extract.extract([source.replace(mark, "")], model)[0].split("\n"))
        scores.append(2 * len(want & got) / (len(want) + len(got)))
    assert np.mean(scores) > 0.95


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=9), st.data())
@settings(max_examples=60, deadline=None)
def test_decode_is_the_best_consistent_labelling(odds, data):
    parents = [-1] + [data.draw(st.integers(0, i)) for i in range(len(odds) - 1)]
    got = html_extract.decode(np.array(odds), parents)
    score = lambda y: sum(o if v else 0 for o, v in zip(odds[1:], y[1:], strict=True))
    n, best = len(odds), -1e9
    for m in range(1 << (n - 1)):
        y = [True] + [bool(m >> i & 1) for i in range(n - 1)]
        if all(y[parents[i]] or not y[i] for i in range(1, n)):
            best = max(best, score(y))
    assert all(got[parents[i]] or not got[i] for i in range(1, n)) and abs(score(got) - best) < 1e-9


def naive_strip(data, window=50):
    first = {}
    for d, t in data:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in data:
        w = words_of(t)
        gone = {i + k for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for k in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_substring(spark, docs):
    data = rows_of(docs, "doc_id", "text")
    got = substring_dedup.strip_repeats(docs, kept_text=True).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == naive_strip(data)
    for r in got:
        assert hashlib.sha256(b" ".join(words_of(r["kept"]))).hexdigest() == r["kept_sha256"]
    assert substring_dedup.strip_repeats(docs.limit(0)).count() == 0
    cut = substring_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 1").count() == 0 and cut.where("doc_id = 0").count() == 1


def test_substring_random(spark):
    """Texts over three words, so that passages overlap, shift and repeat within documents."""
    rng = random.Random(8)
    pool = [[rng.choice("abc") for _ in range(200)] for _ in range(4)]
    data = []
    for i in range(60):
        p = rng.choice(pool)
        s = rng.randint(0, 120)
        data.append((i, " ".join([rng.choice("xyz") for _ in range(rng.randint(0, 20))] + p[s : s + rng.randint(20, 110)] + [rng.choice("xyz") for _ in range(rng.randint(0, 20))])))
    got = substring_dedup.strip_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == naive_strip(data)


@lru_cache
def plain_tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path(name))


SPECIAL = [(500, "<|endoftext|>"), (501, "a b <|endoftext|> c"), (502, "<|startoftext|>Words<|endoftext|>\n<|ENDOFTEXT|>")]


def test_substring_repeated_ids(spark):
    """Rows of one doc_id with different texts: each loses what is its own to lose, and no other row's places."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = prose(80)
    data = [(1, passage), (5, prose(20) + " " + passage + " " + prose(20)), (5, prose(120)), (5, prose(10) + " " + passage), (5, prose(120)), (1, prose(3) + " " + passage), (7, passage)]
    df = spark.createDataFrame([(*d, "x", 1) for d in data + data[1:3]], "doc_id long, text string, around string, anchor int")
    got = substring_dedup.strip_repeats(df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == naive_strip(data + data[1:3])
    spans = rows_of(substring_dedup.maximal_repeats(df), "doc_id", "start", "stop")
    assert sorted(spans) == [(5, 10, 90), (5, 20, 100), (5, 20, 100), (7, 0, 80)]
    assert substring_dedup.cut_repeats(df).columns == df.columns and substring_dedup.cut_repeats(df).count() == 8


def test_spread_join_deals_hot_keys(spark):
    big = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    small = big.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1").withColumn("w", F.col("k") * 2)
    made = spread_join(big, small, ["k"], 5000, hot=50)
    assert sorted(map(tuple, made.collect())) == sorted((k, v, 2 * k) for v in range(5000) if (k := 7 if v % 3 == 0 else v) % 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in spread_join(big, small, ["k"], 5000, hot=50).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 2 * sum(sizes) / 4


def test_packing(spark, docs):
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(SPECIAL, "doc_id long, text string"))
    got = packing.packed(docs).collect()
    t = plain_tokenizer("word_bpe_49k.json")
    want = []
    for d, text in rows_of(docs, "doc_id", "text"):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(d or 0, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.packed(docs.limit(0)).count() == 0


def test_packing_over_shards(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randint(1, 3000), i) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), shard=150)
    assert sorted(rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32")) == rows
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(b["n"] for b in bins) <= 4096 and len(bins) <= 1.03 * -(-sum(r[3] for r in rows) // 4096)


def naive_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing(spark, docs):
    got = mixing.decided(docs).collect()
    assert len(got) == docs.count() and all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    assert sorted(rows_of(mixing.decided(docs), "key", "taken")) == sorted((r["key"], r["taken"]) for r in got)
    assert mixing.decided(docs.limit(0)).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_mixing_targets_and_fit(spark):
    rng = random.Random(5)
    data = [(i, " ".join(["w"] * rng.randint(1, 400)), rng.choice(["a", "b", "b", "b", "b", "Z", None, "é"])) for i in range(600)]
    got = mixing.decided(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    sizes, source = {}, {i: s for i, _, s in data}
    for i, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = naive_targets(sizes)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mixing_repeated_rows(spark):
    """A source that is one row a hundred times meets its target: its rows are taken one by one."""
    row = (7, "w " * 10, "b")
    data = [(i, "w " * 50, "a") for i in range(40)] + [row] * 100 + [(900 + i, "w " * 20, "c") for i in range(50)] + [(None, None, None), (None, "w", None), (None, "w", None)]
    df = spark.createDataFrame([(*d, "k", 1) for d in data], "doc_id long, text string, source string, key string, c int")
    got = mixing.decided(df).collect()
    assert len(got) == len(data) and all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] for r in got if r["size"])
    sizes, taken, want = {}, {}, {}
    for r in got:
        s = {50: "a", 10: "b", 20: "c"}.get(r["size"])
        sizes[s], taken[s], want[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    # the fill stays within its budget, the target in whole words, so each source ends less than one of its documents below
    assert want == pytest.approx(naive_targets(sizes)) and all(-0.5 <= want[s] - taken[s] < n for s, n in (("a", 50), ("b", 10), ("c", 20), (None, 2)))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = {r["doc_id"]: r["n"] for r in mixed.where("source = 'b'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {7: taken["b"] // 10}
    assert sorted(rows_of(mixing.decided(df), "key", "taken")) == sorted((r["key"], r["taken"]) for r in got)


@given(st.lists(st.integers(0, 50), min_size=1, max_size=9))
@settings(max_examples=8, deadline=None)
def test_mixing_levels(spark, sizes):
    want = {f"s{i}": n for i, n in enumerate(sizes)}
    got = mixing.targets(spark.createDataFrame(list(want.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(naive_targets(want) if sum(sizes) else dict.fromkeys(want, 0.0))


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.floats(0, 1))
@settings(max_examples=100, deadline=None)
def test_fill_is_exact_where_a_subset_sum_is(counts, share):
    lengths = sorted(counts)
    n = [counts[x] for x in lengths]
    total = sum(x * c for x, c in zip(lengths, n, strict=True))
    budget = int(total * share)
    take = mixing.fill(lengths, n, budget)
    reach = {0}
    for x, c in zip(lengths, n, strict=True):
        reach = {r + k * x for r in reach for k in range(c + 1)}
    assert all(0 <= k <= c for k, c in zip(take, n, strict=True))
    assert sum(x * k for x, k in zip(lengths, take, strict=True)) == max(r for r in reach if r <= budget)


def test_token_files(spark, docs):
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(SPECIAL, "doc_id long, text string"))
    got = token_files.read_tokens(spark, token_files.write_tokens(docs, scratch(spark, "t"), tokens.public_path("byte_bpe_50k.json"))).collect()
    t = plain_tokenizer("byte_bpe_50k.json")
    want, ids = [], {}
    for d, text in rows_of(docs, "doc_id", "text"):
        ids.setdefault(-1 if d is None else d, []).append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    at = 0
    for d in sorted(ids):
        for x in ids[d]:
            want.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            at += len(x)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_files.read_tokens(spark, token_files.write_tokens(docs.limit(0), scratch(spark, "t"), tokens.public_path("byte_bpe_50k.json"))).count() == 0


PIECES = ["a", "b", "Wort", "École", "naïve", "ŉ", "İx", "ʼn", "e\u0301", " ", "  ", ".", ",", "'s", "\n", "\n\n", "\t", "\u3000", "\xa0", "\u2028", "é", "É.", "1", "$", "\x00", "\x01", "\x1c", ";", "<", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "“q”.", "…", "Σας", "日本。"]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chunks_encode_as_whole_texts(name, drops, texts):
    """Against the library's own call on the whole text, added strings included, wherever they stand."""
    own, plain = tokens.encoder(tokens.public_path(name), drops, "<u4"), plain_tokenizer(name)
    assert own.quick is not None
    texts = [*texts, "<|endoftext|>", "<|endoftext|>x", "x <|endoftext|>", "a<|startoftext|><|endoftext|> b.\nC"]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_on_documents(spark, name, drops, monkeypatch):
    """Real texts, with so few chunks kept that generations change all the time."""
    monkeypatch.setattr(tokens, "KNOWN", 500)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 5000)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    own, plain = tokens.Encoder(tokens.public_path(name), drops, "<u4"), plain_tokenizer(name)
    for text, ids in zip(texts, own.encode([None if t is None else t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_token_files_by_ranges(spark, docs, monkeypatch):
    """A store that cannot be mapped is read by ranges, a few documents at a time."""
    path = token_files.write_tokens(docs, scratch(spark, "t"), tokens.public_path("byte_bpe_50k.json"))
    want = sorted(map(tuple, token_files.read_tokens(spark, path).collect()), key=str)
    monkeypatch.setattr(token_files, "BLOCK", 2)
    monkeypatch.setattr(token_files, "local_path", lambda p: None)
    part = spark.read.parquet(f"{path}/manifest").first()
    flat = token_files.Flat(f"{path}/{part['name']}.tokens", "<u2")
    assert flat.mapped is None and len(flat.items(0, part["n_tokens"])) == part["n_tokens"]
    assert sorted(map(tuple, token_files.read_tokens(spark, path).collect()), key=str) == want
    assert token_files.arrow_uri("s3a://b/k") == "s3://b/k" and token_files.arrow_uri("/x") == "/x"


def test_token_files_without_a_scheme(spark, docs, tmp_path):
    """A bare path is qualified as Spark qualifies it, for the files as for the manifest."""
    path = token_files.write_tokens(docs, str(tmp_path / "bare"), tokens.public_path("byte_bpe_50k.json"))
    assert path == f"file://{tmp_path}/bare" == token_files.qualified(spark, path)
    assert token_files.read_tokens(spark, str(tmp_path / "bare")).count() == docs.count()


def test_topk_groups_are_bounded_by_bytes(spark, monkeypatch):
    assert exact_topk.layout(64) == (2048, 16, 256)
    for dims in (0, 1, 64, 1024, 4096, 1 << 30):
        block, group, asked = exact_topk.layout(dims)
        assert block * group * asked > 0 and (block * group * dims * 16 <= exact_topk.HELD or block * group == 1)
    monkeypatch.setattr(exact_topk, "HELD", 16 * 4096 * 12)  # twelve vectors of 4,096 a group
    rng = np.random.default_rng(4)
    data = [(i, rng.integers(-3, 4, 4096).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, x array<long>")
    got = rows_of(exact_topk.search(df, df.where("vec_id % 20 = 0"), 3), "query_id", "rank", "vec_id", "score")
    for q in (0, 20, 40):
        best = sorted((-int(np.dot(data[q][1], x)), i) for i, x in data if i != q)[:3]
        assert [(i, -s) for s, i in best] == [(v, s) for a, _, v, s in sorted(got) if a == q]


def test_genetic_search_beats_best_fit():
    """Items in threes that fill a bin exactly: best fit by falling length wastes bins, crossover wins some back."""
    rng, lengths = random.Random(1), []
    for _ in range(40):
        a = rng.randint(380, 490)
        b = rng.randint(250, 750 - a)
        lengths += [a, b, 1000 - a - b]
    plain = packing.best_fit(sorted(range(120), key=lambda i: -lengths[i]), lengths, 1000, [])
    before: list = []
    for epoch in range(4):
        after = packing.evolve(lengths, 1000, before, [], epoch, generations=100)
        assert not before or len(after[0]) <= len(before[0])
        before = after
    best = before[0]
    assert sorted(i for b in best for i in b) == list(range(120)) and all(sum(lengths[i] for i in b) <= 1000 for b in best)
    assert len(plain) >= 47 and len(best) <= len(plain) - 3
    assert packing.from_bytes(packing.to_bytes(best, 120)) == best


def test_crossover_keeps_injected_bins_whole():
    lengths = [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]
    one, other = [(0, 2, 8), (1, 3, 9), (4, 5, 6), (7,)], [(0, 1), (2, 4, 5), (3, 6, 7, 8, 9)]
    for seed in range(20):
        child = packing.cross(one, other, lengths, 10, random.Random(seed))
        assert sorted(i for b in child for i in b) == list(range(10)) and all(sum(lengths[i] for i in b) <= 10 for b in child)
        assert set(child) & set(other)
