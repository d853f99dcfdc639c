"""Retrieval: BM25, dense, hybrid, export of test collections, and ranking metrics."""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators.similarity import similar_topk
from lodestone.plans.catalog import query
from lodestone.plans.joins import spread_join, stable, written
from lodestone.plans.tables import table

K1, B, EPSILON = 1.5, 0.75, 0.25  # fixed values: the usual Okapi constants
TOP = 20
QUERY_BLOCK, CELL = 64, 4096  # queries whose scores a task holds together; queries, and vectors, of one cell


def _rank(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_idf(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(token, df, idf) from (doc_id, token, tf): negative weights are floored at a share of the mean weight."""
    return idf_of(tf.groupBy("token").agg(F.count("*").alias("df")), n_docs)


def idf_of(df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(token, df, idf) from (token, df)."""
    raw = df.crossJoin(F.broadcast(n_docs)).withColumn("raw", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def postings(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, token, tf, dl) of docs (doc_id, text), dealt by document: what is grouped by document is not dealt again.

    Texts are dealt, not postings, which are several times as large. `only`, a bounded table of tokens, leaves out others."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.select("doc_id", "text").repartition(n, "doc_id").select("doc_id", X.tokens_alnum(F.col("text")).alias("w"))
    each = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("token"))
    each = each if only is None else each.join(F.broadcast(only.select("token").distinct()), "token", "left_semi")
    return each.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def bm25_stats(docs: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, idf) of docs: stats is one row (n_docs, avgdl), idf (token, df, idf) of `tokens`, its mean weight that of all tokens."""
    per = docs.groupBy("doc_id").agg(F.max(F.size(X.tokens_alnum(F.col("text")))).alias("dl"))
    stats = written(per.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")), "stats")  # one row
    df = written(postings(docs).groupBy("token").agg(F.count("*").alias("df")), "df")
    return stats, written(idf_of(df, stats.select("n_docs")).join(tokens.select("token").distinct(), "token"), "idf")


ASKED = 200_000  # tokens of queries that one pass over the documents answers: they are broadcast


def bm25(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(qid, doc_id, rank, score) of the k best documents; those without a match score 0, in the order of their ids.

    docs (doc_id, text), queries (qid, text). Documents are dealt by their id, and the tokens of up to ASKED query words meet
    each part: a document's matches are made and summed where it is, and only a part's k best of a query travel. More
    queries take more passes. Cost follows matching postings, never queries times documents, and no postings are kept."""
    q = written(queries.select("qid", F.explode(X.tokens_alnum(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf")), "asked")
    stats, idf = bm25_stats(docs, q)
    asked = written(q.join(idf.drop("df"), "token"), "weighed")
    passes = max(1, -(-asked.count() // ASKED))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = None
    for i in range(passes):
        some = F.broadcast(asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i))  # about ASKED rows
        hits = postings(docs, some).join(some, "token").crossJoin(F.broadcast(stats.select("avgdl")))
        best = written(_rank(hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("score")), k).select("qid", "doc_id", "rank", "score"), "best")
        scored = best if scored is None else scored.union(best)
    return with_zeros(scored, docs, queries, k)


def with_zeros(scored: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """scored (qid, doc_id, rank, score) and, for queries with fewer than k matches, documents of score 0, ids ascending.

    A query's other places are among the first 2 k documents: at most k of those match."""
    short = queries.select("qid").distinct().join(scored.groupBy("qid").agg(F.count("*").alias("had")), "qid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where(F.col("had") < k)
    early = F.broadcast(docs.select("doc_id").orderBy("doc_id").limit(2 * k))
    zero = short.crossJoin(early).join(scored.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    rest = zero.withColumn("rank", F.col("had").cast("int") + F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).where(F.col("rank") <= k)
    return scored.union(rest.select("qid", "doc_id", "rank", F.lit(0.0).alias("score")))


BM25 = r"""
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
raw AS (SELECT token, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), st),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS qid, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN tf USING (token) JOIN idf USING (token) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
al AS (SELECT item_id AS qid, dl.doc_id AS doc_id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN dl LEFT JOIN sc ON sc.qid = item_id AND sc.doc_id = dl.doc_id),
bm AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM al) WHERE rank <= {k})"""


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query("bm25_idf", "WITH " + BM25.format(k=20) + " SELECT token, round(idf, 6) AS idf FROM idf")
def _idf(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(X.tokens_alnum(F.col("text"))).alias("token")).distinct()
    n = table(spark, d, "documents").agg(F.count("*").alias("n_docs"))
    return bm25_idf(w, n).select("token", F.round("idf", 6).alias("idf"))


@query("bm25_topk", "WITH " + BM25.format(k=20) + " SELECT qid, doc_id, rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark, d):
    return bm25(table(spark, d, "documents"), _items(spark, d)).withColumn("score", F.round("score", 6))


def unit(c):
    """A vector over its length, in double."""
    wide = F.transform(c, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length)).otherwise(wide)


def _matrix(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at unit length as rows, those shorter than the longest filled up with zeros, and the length each had; -1 if it is null or holds a null."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    sizes = np.where(pc.is_null(c).to_numpy(zero_copy_only=False), -1, pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False))
    flat, at = c.flatten(), np.repeat(np.arange(len(c)), np.maximum(sizes, 0))
    m = np.zeros((len(c), max(1, int(sizes.max(initial=0)))))
    m[at, np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes[at[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    length = np.sqrt((m * m).sum(1))
    return np.divide(m, length[:, None], out=m, where=(length > 0)[:, None]), sizes


def _best(queries: pa.Table, vectors: pa.Table, k: int, kinds: pa.Schema) -> pa.Table:
    """The k best of a cell's vectors for each of its queries, by score in nine digits, then id; a null score comes last."""
    if not queries.num_rows or not vectors.num_rows:
        return kinds.empty_table()
    (q, q_size), (v, v_size) = _matrix(queries["asked"]), _matrix(vectors["vector"])
    qid, doc = (t[c].to_numpy() for t, c in ((queries, "qid"), (vectors, "doc_id")))
    wide, found = max(q.shape[1], v.shape[1]), []
    q, v = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, v))
    for i in range(0, len(q), QUERY_BLOCK):
        scores = q[i : i + QUERY_BLOCK] @ v.T
        for j, row in enumerate(scores, i):
            none = (v_size != q_size[j]) | (v_size < 0)
            order = np.where(none, -np.inf, np.where(np.isnan(row), np.inf, np.round(row, 9)))
            own = np.flatnonzero(doc != qid[j])
            if len(own) > k:
                own = own[order[own] >= np.partition(order[own], len(own) - k)[len(own) - k]]
            own = own[np.lexsort((doc[own], -order[own]))[:k]]
            found.append((np.full(len(own), qid[j]), doc[own], row[own], none[own]))
    a, b, c, none = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table([pa.array(a, kinds.field(0).type), pa.array(b, kinds.field(1).type), pa.array(c, pa.float64(), mask=none)], schema=kinds)


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, rank, score): a stated query set against all vectors, exactly, in cells of about CELL queries and CELL vectors.

    vectors (doc_id, embedding), queries (qid, embedding), ids of the same kind of integer. A cell is one matrix product, and
    gives k rows a query; so no task and no broadcast holds either side. Vectors are taken at unit length, as cosine similarity
    wants; one of zeros scores 0, one that is null, holds a null or is of another length has a null score and comes last."""
    n_v, n_q = (max(1, -(-df.count() // CELL)) for df in (vectors, queries))
    turn = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = vectors.where("doc_id IS NOT NULL").select("doc_id", F.col("embedding").alias("vector"), turn("doc_id", n_v).alias("v"), every(n_q).alias("q"))
    q = queries.where("qid IS NOT NULL").select("qid", F.col("embedding").alias("asked"), turn("qid", n_q).alias("q"), every(n_v).alias("v"))
    kinds = to_arrow_schema(StructType([queries.schema["qid"], vectors.schema["doc_id"], StructField("score", DoubleType())]))
    cells = q.groupBy("q", "v").cogroup(v.groupBy("q", "v")).applyInArrow(lambda a, b: _best(a, b, k, kinds), from_arrow_schema(kinds))
    return _rank(cells, k).select("qid", "doc_id", "score", "rank")


DENSE = """
dn AS (SELECT q.vec_id AS qid, c.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM dn) WHERE rank <= 20)"""


def _dense(spark, d, k=TOP):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return dense(v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), k)


@query("dense_topk", "WITH " + DENSE + " SELECT qid, doc_id, rank, round(score, 6) AS score FROM dr")
def _dense_topk(spark, d):
    return _dense(spark, d).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def _minmax(c: str):
    w = Window.partitionBy("qid")
    spread = F.max(c).over(w) - F.min(c).over(w)
    return F.when(spread < 1e-12, F.lit(0.0)).otherwise((F.col(c) - F.min(c).over(w)) / spread)


@query("hybrid_topk", "WITH " + BM25.format(k=200) + """,
h AS (SELECT qid, doc_id, score, coalesce(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS dense FROM bm LEFT JOIN embeddings a ON a.vec_id = qid LEFT JOIN embeddings b ON b.vec_id = doc_id),
n AS (SELECT *, max(score) OVER w - min(score) OVER w AS sb, min(score) OVER w AS lb, max(dense) OVER w - min(dense) OVER w AS sd, min(dense) OVER w AS ld FROM h WINDOW w AS (PARTITION BY qid)),
m AS (SELECT qid, doc_id, 0.5::DOUBLE * CASE WHEN sb < 1e-12 THEN 0 ELSE (score - lb) / sb END + 0.5::DOUBLE * CASE WHEN sd < 1e-12 THEN 0 ELSE (dense - ld) / sd END AS score FROM n)
SELECT qid, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM m) WHERE rank <= 20""")
def _hybrid(spark, d):
    """BM25's 200 best, rescored: half the min-max BM25 score, half the min-max dense score."""
    v = table(spark, d, "embeddings")
    hits = bm25(table(spark, d, "documents"), _items(spark, d), 200)
    dot = F.aggregate(F.zip_with("qe", "de", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    hits = hits.join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe")), "qid", "left").join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("de")), "doc_id", "left")
    hits = hits.select("qid", "doc_id", "score", F.coalesce(dot, F.lit(0.0)).alias("dense"))
    mixed = hits.select("qid", "doc_id", (0.5 * _minmax("score") + 0.5 * _minmax("dense")).alias("score"))
    return _rank(mixed, TOP).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(metric, value): means over the queries of qrels; a query without a run counts as 0."""
    hit = qrels.join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    gain = lambda k: F.sum(F.when(F.col("rank") <= k, 1 / (F.ln(F.col("rank") + 1.0) / F.ln(F.lit(2.0)))).otherwise(0.0))
    per = hit.groupBy("qid").agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (5, 10, 20)], F.min("rank").alias("first"), gain(10).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(F.lit(2.0)) / F.ln(i + 1.0))
    out = per.agg(*[F.avg(F.col(f"h{k}") / F.col("n")).alias(f"recall@{k}") for k in (5, 10, 20)], F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)).alias("mrr@10"), F.avg(F.col("dcg") / ideal).alias("ndcg@10"))
    return out.unpivot([], out.columns, "metric", "value").select("metric", F.round("value", 6).alias("value"))


METRICS = """
per AS (SELECT qid, count(*) AS n, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, min(rank) AS f, sum(CASE WHEN rank <= 10 THEN 1 / (ln(rank + 1) / ln(2)) ELSE 0 END) AS dcg FROM qrels LEFT JOIN run USING (qid, doc_id) GROUP BY qid),
x AS (SELECT *, list_sum(list_transform(range(1, least(10, n) + 1), lambda i: ln(2) / ln(i + 1))) AS ideal FROM per)
SELECT 'recall@5' AS metric, round(avg(h5 / n::DOUBLE), 6) AS value FROM x UNION ALL SELECT 'recall@10', round(avg(h10 / n::DOUBLE), 6) FROM x UNION ALL SELECT 'recall@20', round(avg(h20 / n::DOUBLE), 6) FROM x
UNION ALL SELECT 'mrr@10', round(avg(CASE WHEN f <= 10 THEN 1 / f::DOUBLE ELSE 0 END), 6) FROM x UNION ALL SELECT 'ndcg@10', round(avg(dcg / ideal), 6) FROM x"""


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents that hold an item word for word.

    Items of five words or more are joined on their second to fourth words, which are whole words of any such document.
    Shorter ones have no such key. Up to PATTERNS of them, whose texts are then a bounded list, are looked for in one
    pass over the documents; more are joined on their first characters."""
    parts = F.split("text", r"\s+")
    split = docs.select("doc_id", parts.alias("w"))  # a column of its own, so that no lambda splits again
    grams = split.select("doc_id", F.explode(F.array_distinct(F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2))))).alias("g"))
    few = F.size(parts) < 5
    keyed = items.where(~few).select("qid", F.col("text").alias("item"), F.xxhash64(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))).alias("g"))
    found = grams.select("doc_id", "g").join(keyed, "g").select("qid", "item", "doc_id").distinct()
    long = found.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("qid", "doc_id")
    short = stable(items.where(few & F.col("text").isNotNull()).select("qid", F.col("text").alias("item")))
    listed = short.where(F.length("item") <= PATTERN).limit(PATTERNS + 1).collect()  # bounded in number and length
    if not listed and short.isEmpty():
        return long
    if len(listed) <= PATTERNS and short.count() == len(listed):
        texts = sorted({r["item"] for r in listed})
        held = docs.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, texts)), lambda t: F.contains("text", t))).alias("item"))
        return long.union(held.join(F.broadcast(short), "item").select("qid", "doc_id"))  # as many rows as were listed
    return long.union(_by_first_characters(docs, short))


PATTERNS, PATTERN = 500, 200  # short items in one pass, and the length of each
FIRST = 4  # characters of a short item's key


def _by_first_characters(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents that hold an item (qid, item), joined on its first FIRST characters, all if it has fewer.

    Documents are taken apart into characters once and give each run of that many once, and the empty one, which is an
    empty item's key; common runs are dealt over tasks."""
    some = items.withColumn("key", F.substring("item", 1, FIRST))
    chars = docs.where("text IS NOT NULL").select("doc_id", F.split("text", "").alias("c"))
    upto = F.filter(F.array(*[F.lit(k) for k in range(1, FIRST + 1)]), lambda k: k <= F.size("c"))
    runs = F.flatten(F.transform(upto, lambda k: F.transform(F.sequence(F.lit(1), F.size("c") - k + 1), lambda i: F.array_join(F.slice("c", i, k), ""))))
    held = stable(chars.select("doc_id", F.explode(F.array_distinct(F.array_append(runs, F.lit("")))).alias("key")).join(some.select("key").distinct(), "key", "left_semi"))
    sizes = held.groupBy("key").agg(F.count("*").alias("n"))
    met = spread_join(held, some.join(sizes, "key"), ["key"], held.count(), by="doc_id", many=True)
    return met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("qid", "doc_id").distinct()


@query("bm25_metrics", "WITH " + BM25.format(k=20) + ", run AS (SELECT * FROM bm), qrels AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))," + METRICS)
def _bm25_metrics(spark, d):
    docs, items = table(spark, d, "documents").select("doc_id", "text"), _items(spark, d)
    return metrics(bm25(docs, items), verbatim(docs, items))


@query("dense_metrics", "WITH " + DENSE + ", run AS (SELECT * FROM dr), qrels AS (SELECT q.vec_id AS qid, c.vec_id AS doc_id FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)," + METRICS)
def _dense_metrics(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    rel = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label").join(v, "label").where("qid <> vec_id").select("qid", F.col("vec_id").alias("doc_id"))
    return metrics(_dense(spark, d), rel)


@query("beir_corpus", "SELECT doc_id::VARCHAR AS _id, coalesce(nullif(source, ''), '') AS title, text FROM documents")
def _beir_corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.coalesce(F.nullif("source", F.lit("")), F.lit("")).alias("title"), "text")


@query("beir_queries", "SELECT item_id::VARCHAR AS _id, text FROM benchmark")
def _beir_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text")


@query("beir_qrels", "SELECT item_id AS qid, doc_id, 1::INTEGER AS score FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def _beir_qrels(spark, d):
    return verbatim(table(spark, d, "documents").select("doc_id", "text"), _items(spark, d)).withColumn("score", F.lit(1))


@query("similar_peers_topk", r"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS s FROM conversations),
p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn),
j AS (SELECT conv_id, a, b, i / (na + nb - i)::DOUBLE AS jaccard FROM p WHERE i > 0)
SELECT conv_id, a, b, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY round(jaccard, 9) DESC, b) AS r FROM j) WHERE r <= 10""")
def _peers(spark, d):
    """The ten most similar turns of a turn's conversation."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("id"), F.lit(True).alias("asked"), X.word_set(F.col("text")).alias("s"))
    return similar_topk(rows).select(F.col("g").alias("conv_id"), F.col("id").alias("a"), F.col("peer").alias("b"), F.round("jaccard", 6).alias("jaccard"))


DIMS = 64


def hashed_vectors(texts: DataFrame) -> DataFrame:
    """(id, embedding) of texts (id, text) without a model: signed counts of hashed words, at unit length, batch by
    batch in Arrow. A stand-in with an encoder's interface; a text without a word is all zeros."""

    @F.pandas_udf("array<float>")
    def encode(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            v = np.zeros(DIMS)
            for w in re.findall("[a-z0-9]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % DIMS] += 1 if h >> 31 else -1
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return texts.select("id", encode("text").alias("embedding"))


@query("encoded_vectors")
def _encoded(spark, d):
    got = hashed_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return got.select("id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))
