"""BM25 document by document: postings do not travel, and queries may take several passes."""

from pyspark.sql import functions as F

from lodestone.operators import retrieval_queries as R
from lodestone.plans.tables import table

SF = "/root/testdata/sf0.001"


def test_postings_are_grouped_where_their_document_is(spark):
    """One exchange, of the texts: postings and their sums by query and document stay in their part."""
    docs = table(spark, SF, "documents")
    hits = R.postings(docs).join(F.broadcast(spark.createDataFrame([("the", 1)], "token string, qid long")), "token")
    plan = hits.groupBy("qid", "doc_id").agg(F.sum("tf"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_passes_agree(spark, monkeypatch):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame([(10**6, ""), (10**6 + 1, None)], "doc_id long, text string"))
    items = table(spark, SF, "benchmark").select(F.col("item_id").alias("qid"), "text").union(spark.createDataFrame([(-1, "zzqq"), (-2, None)], "qid long, text string"))
    one = sorted(tuple(r) for r in R.bm25(docs, items, 5).select("qid", "rank", "doc_id", F.round("score", 9)).collect())
    monkeypatch.setattr(R, "ASKED", 500)
    assert sorted(tuple(r) for r in R.bm25(docs, items, 5).select("qid", "rank", "doc_id", F.round("score", 9)).collect()) == one
    assert len(one) == 5 * items.count()
