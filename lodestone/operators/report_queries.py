"""Reports over call logs, pools and evaluations, audit samples, and the planning of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators.candidates import drawn, normalized_reason
from lodestone.operators.metrics_queries import BUDGETS, CALLS, PRED, QA, R, calls, p_index, predictions, qa_evidence, ranked_values
from lodestone.operators.retrieval_queries import BM25, DENSE, _dense, _items, bm25, verbatim
from lodestone.operators.similarity import places, similar_topk
from lodestone.operators.text_queries import MATCH
from lodestone.plans.catalog import query
from lodestone.plans.joins import HOT, spread_join, stable, written
from lodestone.plans.tables import table

# ---- pool quality and coverage --------------------------------------------------------------------------------------


def quality_report(pool: DataFrame, reason: str = "reason") -> DataFrame:
    """(metric, value) of a pool (unknown, closed_book, hops, reason, edge, copy): rows, fractions, reasons."""
    one = pool.agg(F.count("*").cast("double").alias("rows"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_frac") for c in ("unknown", "closed_book")], F.avg((F.col("hops") >= 2).cast("double")).alias("multihop_frac"), *[f(F.col(c)).alias(f"{c}_{n}") for c in ("edge", "copy") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    long = one.unpivot([], one.columns, "metric", "value")
    return long.union(pool.groupBy(F.concat(F.lit("reason:"), normalized_reason(F.col(reason))).alias("metric")).agg(F.count("*").cast("double").alias("value")))


@query("quality_report", f"""WITH {QA}, p AS (SELECT item, any_value(reason) AS reason, bool_or(unknown) AS unknown, count(*) AS hops FROM qa GROUP BY item),
q AS (SELECT reason, unknown, item % 3 = 0 AS closed_book, hops, (item % 101) / 100::DOUBLE AS edge, (item % 67) / 100::DOUBLE AS copy FROM p),
a AS (SELECT count(*)::DOUBLE AS rows, avg(unknown::INT) AS unknown_frac, avg(closed_book::INT) AS closed_book_frac, avg((hops >= 2)::INT) AS multihop_frac, avg(edge) AS edge_mean, min(edge) AS edge_min, max(edge) AS edge_max, avg(copy) AS copy_mean, min(copy) AS copy_min, max(copy) AS copy_max FROM q)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'reason:' || reason, count(*)::DOUBLE FROM q GROUP BY reason""")
def _quality(spark, d):
    p = qa_evidence(spark, d).groupBy("item").agg(F.first("reason").alias("reason"), F.bool_or("unknown").alias("unknown"), F.count("*").alias("hops"))
    q = p.select("reason", "unknown", (F.col("item") % 3 == 0).alias("closed_book"), "hops", ((F.col("item") % 101) / 100).alias("edge"), ((F.col("item") % 67) / 100).alias("copy"))
    return quality_report(q).select("metric", R("value").alias("value"))


@query("unit_ratio", f"WITH {QA} SELECT unknown, count(DISTINCT unit) AS covered, round(count(DISTINCT unit)::DOUBLE / (SELECT count(DISTINCT p_brand) FROM part), 6) AS unitcov FROM qa GROUP BY unknown")
def _unit_ratio(spark, d):
    units = table(spark, d, "part").agg(F.countDistinct("p_brand").alias("units"))  # one row
    n = qa_evidence(spark, d).groupBy("unknown").agg(F.countDistinct("unit").alias("covered"))
    return n.crossJoin(F.broadcast(units)).select("unknown", "covered", R(F.col("covered") / F.col("units")).alias("unitcov"))


@query("prefix_report", f"""WITH {QA}, r AS (SELECT o_orderkey AS item, lower(trim(o_orderpriority)) AS reason, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders)
SELECT b AS budget, reason, b AS num_examples, count(item) AS n FROM (SELECT unnest([100, 500, 1000, 5000])::BIGINT AS b) JOIN r ON rank <= b GROUP BY b, reason""")
def _prefix(spark, d):
    """Reasons within each budget; num_examples repeats the budget even where fewer rows exist."""
    within = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.lower(F.trim("o_orderpriority")).alias("reason")).orderBy("item").limit(BUDGETS[-1])
    r = within.withColumn("rank", F.row_number().over(Window.orderBy("item")))  # as many rows as the largest budget
    b = r.withColumn("budget", F.explode(F.filter(F.array(*[F.lit(x).cast("long") for x in BUDGETS]), lambda x: F.col("rank") <= x)))
    return b.groupBy("budget", "reason").agg(F.count("*").alias("n")).withColumn("num_examples", F.col("budget"))


@query("composition", f"WITH {PRED}, p AS (SELECT kind, CASE WHEN kind = 'near_miss' THEN 'UNANSWERABLE' ELSE 'ANSWERABLE' END AS label FROM pred) SELECT CASE WHEN grouping(kind) = 0 THEN 'type' ELSE 'label' END AS level, coalesce(kind, label) AS key, count(*) AS n FROM p GROUP BY GROUPING SETS ((kind), (label))")
def _composition(spark, d):
    p = predictions(spark, d).select("kind", F.when(F.col("kind") == "near_miss", "UNANSWERABLE").otherwise("ANSWERABLE").alias("label"))
    g = p.groupingSets([["kind"], ["label"]], "kind", "label").agg(F.count("*").alias("n"), F.grouping("kind").alias("g"))
    return g.select(F.when(F.col("g") == 0, "type").otherwise("label").alias("level"), F.coalesce("kind", "label").alias("key"), "n")


FLAGS = """f AS (SELECT doc_id, CASE WHEN coalesce(trim(lang), '') = '' THEN 'unknown' ELSE lower(trim(lang)) END AS reason, CASE WHEN length(source) % 2 = 0 THEN 'multi-hop' ELSE 'single-hop' END AS hop, toxic = 1 AS cb, quality = 1 AS ctx, row_number() OVER (ORDER BY doc_id) AS rank FROM labels JOIN documents USING (doc_id))"""


@query("flags_by_budget_reason_hop", f"""WITH {FLAGS}, l AS (SELECT 'budget' AS level, b::VARCHAR AS key, cb, ctx FROM f, (SELECT unnest([100, 500, 1000, 5000]) AS b) WHERE rank <= b
UNION ALL SELECT 'reason', reason, cb, ctx FROM f WHERE rank <= 5000 UNION ALL SELECT 'hop', hop, cb, ctx FROM f WHERE rank <= 5000)
SELECT level, key, count(*) AS n, round(avg(cb::INT), 6) AS cb_acc, round(avg(ctx::INT), 6) AS ctx_acc, round(avg((NOT cb AND ctx)::INT), 6) AS unknown_purity FROM l GROUP BY level, key""")
def _flags_by(spark, d):
    """Accuracies of each budget's prefix, and of the largest by reason and by hop."""
    f = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").orderBy("doc_id").limit(BUDGETS[-1])
    f = f.select(F.row_number().over(Window.orderBy("doc_id")).alias("rank"), normalized_reason(F.col("lang")).alias("reason"), F.when(F.length("source") % 2 == 0, "multi-hop").otherwise("single-hop").alias("hop"), (F.col("toxic") == 1).alias("cb"), (F.col("quality") == 1).alias("ctx"))
    tag = lambda level, key: F.struct(F.lit(level).alias("level"), key.alias("key"))
    budgets = F.transform(F.filter(F.array(*map(F.lit, BUDGETS)), lambda b: F.col("rank") <= b), lambda b: tag("budget", b.cast("string")))
    long = f.select("cb", "ctx", F.explode(F.concat(budgets, F.array(tag("reason", F.col("reason")), tag("hop", F.col("hop"))))).alias("t"))
    acc = lambda c: R(F.avg(c.cast("int")))
    return long.groupBy("t.level", "t.key").agg(F.count("*").alias("n"), acc(F.col("cb")).alias("cb_acc"), acc(F.col("ctx")).alias("ctx_acc"), acc(~F.col("cb") & F.col("ctx")).alias("unknown_purity"))


# ---- call logs --------------------------------------------------------------------------------------------------------


@query("call_totals", "SELECT CASE WHEN grouping(event_type) = 0 THEN 'ns' WHEN grouping(m) = 0 THEN 'model' ELSE 'all' END AS level, coalesce(event_type, m, '') AS key, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_fail, floor(epoch(min(ts)))::BIGINT AS first_s, floor(epoch(max(ts)))::BIGINT AS last_s, (floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT) AS span_s FROM (SELECT *, 'm' || (user_id % 3) AS m FROM events) GROUP BY GROUPING SETS ((), (event_type), (m))")
def _totals(spark, d):
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("m"), F.col("user_id") % 3).alias("m"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    ok = F.col("event_type") != "error"
    g = e.groupingSets([[], ["event_type"], ["m"]], "event_type", "m").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_fail"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.grouping("event_type").alias("ge"), F.grouping("m").alias("gm"))
    return g.select(F.when(F.col("ge") == 0, "ns").when(F.col("gm") == 0, "model").otherwise("all").alias("level"), F.coalesce("event_type", "m", F.lit("")).alias("key"), "n", "n_ok", "n_fail", "first_s", "last_s", (F.col("last_s") - F.col("first_s")).alias("span_s"))


ERRORS = "e AS (SELECT 'ns' || (user_id % 4) AS ns, 'm' || (user_id % 3) AS model, coalesce(nullif(regexp_extract('HTTP ' || (['429','500','404','418'])[event_id % 4 + 1], 'HTTP (400|401|403|404|405|429|500)', 1), ''), 'other') AS code FROM events WHERE event_type = 'error')"


@query("error_histogram", f"WITH {ERRORS} SELECT CASE WHEN grouping(ns) = 0 THEN 'ns' WHEN grouping(model) = 0 THEN 'model' ELSE 'all' END AS level, coalesce(ns, model, '') AS key, code, count(*) AS n FROM e GROUP BY GROUPING SETS ((code), (ns, code), (model, code))")
def _error_histogram(spark, d):
    said = F.concat(F.lit("HTTP "), F.element_at(F.array(*map(F.lit, ("429", "500", "404", "418"))), (F.col("event_id") % 4 + 1).cast("int")))
    code = F.coalesce(F.nullif(F.regexp_extract(said, "HTTP (400|401|403|404|405|429|500)", 1), F.lit("")), F.lit("other"))
    e = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("ns"), F.col("user_id") % 4).alias("ns"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), code.alias("code"))
    g = e.groupingSets([["code"], ["ns", "code"], ["model", "code"]], "ns", "model", "code").agg(F.count("*").alias("n"), F.grouping("ns").alias("gn"), F.grouping("model").alias("gm"))
    return g.select(F.when(F.col("gn") == 0, "ns").when(F.col("gm") == 0, "model").otherwise("all").alias("level"), F.coalesce("ns", "model", F.lit("")).alias("key"), "code", "n")


def cost_model(usage: DataFrame) -> DataFrame:
    """(estimate, tokens) from usage (ns, calls, tokens) of the stages closed_book, ctx, verify, equiv, gen and gen_mh.

    A baseline without edge scores answers and verifies every candidate: per-call averages times the closed-book
    calls; a judge's calls shrink by the share of comparisons that are left. Rounding is half to even."""
    tok = lambda ns: F.coalesce(F.sum(F.when(F.col("ns") == ns, F.col("tokens"))), F.lit(0))
    num = lambda ns: F.coalesce(F.sum(F.when(F.col("ns") == ns, F.col("calls"))), F.lit(0))
    one = usage.agg(*[f(ns).alias(f"{k}_{ns}") for ns in ("closed_book", "ctx", "verify", "equiv", "gen", "gen_mh", "para") for k, f in (("t", tok), ("n", num))])
    avg = lambda ns: F.when(F.col(f"n_{ns}") > 0, F.col(f"t_{ns}") / F.col(f"n_{ns}")).otherwise(0.0)
    scaled = lambda x: F.bround(x, 0).cast("long")
    cands = F.col("n_closed_book")
    compared = F.greatest(F.lit(1), cands + F.col("n_ctx") + F.col("n_para"))
    ctx, ver = scaled(avg("ctx") * cands), scaled(avg("verify") * cands)
    judge = scaled(avg("equiv") * scaled(F.col("n_equiv") * (cands / compared)))
    base = F.col("t_gen") + F.col("t_gen_mh") + ctx + ver
    made = one.select(F.lit(0).cast("long").alias("selection_only"), (base + judge).cast("long").alias("no_edge_scores"), base.cast("long").alias("no_edge_scores_no_judge"), scaled(avg("closed_book") * cands).alias("self_knowledge_extra"))
    return made.unpivot([], made.columns, "estimate", "tokens")


STAGES_OF = {"click": "closed_book", "view": "ctx", "purchase": "verify", "signup": "equiv", "error": "gen"}


@query("cost_model", f"""WITH {CALLS}, u AS (SELECT {"CASE ns " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STAGES_OF.items()) + " ELSE ns END"} AS ns, count(*) AS calls, sum(tokens)::BIGINT AS tokens FROM calls GROUP BY 1),
o AS (SELECT """ + ", ".join(f"coalesce(sum(tokens) FILTER (ns = '{n}'), 0)::BIGINT AS t_{n}, coalesce(sum(calls) FILTER (ns = '{n}'), 0)::BIGINT AS n_{n}" for n in ("closed_book", "ctx", "verify", "equiv", "gen", "gen_mh", "para")) + """ FROM u),
p AS (SELECT *, round_even(CASE WHEN n_ctx > 0 THEN t_ctx / n_ctx ELSE 0 END * n_closed_book, 0) AS ctx, round_even(CASE WHEN n_verify > 0 THEN t_verify / n_verify ELSE 0 END * n_closed_book, 0) AS ver,
  round_even(CASE WHEN n_equiv > 0 THEN t_equiv / n_equiv ELSE 0 END * round_even(n_equiv * (n_closed_book / greatest(1, n_closed_book + n_ctx + n_para)), 0), 0) AS judge FROM o)
SELECT 'selection_only' AS estimate, 0::BIGINT AS tokens UNION ALL SELECT 'no_edge_scores', (t_gen + t_gen_mh + ctx + ver + judge)::BIGINT FROM p UNION ALL SELECT 'no_edge_scores_no_judge', (t_gen + t_gen_mh + ctx + ver)::BIGINT FROM p
UNION ALL SELECT 'self_knowledge_extra', round_even(CASE WHEN n_closed_book > 0 THEN t_closed_book / n_closed_book ELSE 0 END * n_closed_book, 0)::BIGINT FROM p""")
def _cost(spark, d):
    names = F.create_map(*[F.lit(x) for kv in STAGES_OF.items() for x in kv])
    return cost_model(calls(spark, d).groupBy(F.coalesce(names[F.col("ns")], F.col("ns")).alias("ns")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")))


@query("batch_usage", "SELECT count(*) AS n, count(*) FILTER (v IS NULL) AS n_bad, coalesce(sum(v), 0)::BIGINT AS tokens FROM (SELECT try_cast(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE json_extract_string(props, '$.k') END AS BIGINT) AS v FROM events)")
def _batch_usage(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.get_json_object("props", "$.k")).try_cast("long")
    return table(spark, d, "events").select(v.alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_bad"), F.coalesce(F.sum("v"), F.lit(0)).alias("tokens"))


LOAD = f"WITH {CALLS}, l AS (SELECT list_sort(list(elapsed)) AS x, count(*) AS n FROM calls WHERE ok)"


@query("load_summary", LOAD + """, t AS (SELECT count(*) AS total, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS s FROM events)
SELECT total, n AS n_ok, total - n AS n_err, round(CASE WHEN s > 0 THEN total / s::DOUBLE ELSE 0 END, 9) AS rps, round(list_avg(x), 6) AS mean, round(x[greatest(1, least(n, floor(n * 0.5::DOUBLE)::BIGINT))], 6) AS p50, round(x[greatest(1, least(n, floor(n * 0.9::DOUBLE)::BIGINT))], 6) AS p90, round(list_max(x), 6) AS max FROM l, t""")
def _load(spark, d):
    """Requests, rate, and latencies of those that succeeded; an index below the first value is the first."""
    e = table(spark, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    t = e.agg(F.count("*").alias("total"), (F.max("s") - F.min("s")).alias("s"))
    r = ranked_values(calls(spark, d).where("ok").select(F.lit("all").alias("ns"), "elapsed"), "ns", "elapsed")
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(q)).cast("long")), F.col("elapsed")))
    l = r.agg(F.first("n").alias("n_ok"), R(F.sum(F.col("elapsed") * F.col("c")) / F.first("n")).alias("mean"), R(at(0.5)).alias("p50"), R(at(0.9)).alias("p90"), R(F.max("elapsed")).alias("max"))
    both = t.crossJoin(F.broadcast(l))  # one row each
    return both.select("total", "n_ok", (F.col("total") - F.col("n_ok")).alias("n_err"), F.round(F.when(F.col("s") > 0, F.col("total") / F.col("s")).otherwise(0.0), 9).alias("rps"), "mean", "p50", "p90", "max")


@query("run_summary", f"WITH {CALLS} SELECT (SELECT count(*) FROM documents) AS mined, (SELECT count(*) FROM labels) AS pool, (SELECT count(*) FROM labels WHERE quality = 1) AS selected, (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 0) AS unknown, (SELECT count(*) FROM calls) AS n_calls, (SELECT count(*) FROM calls WHERE NOT ok) AS failures, (SELECT count(*) FROM labels) + (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS units_planned")
def _run_summary(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    left = docs.join(labels.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("left"))
    parts = [docs.agg(F.count("*").alias("mined")), labels.agg(F.count("*").alias("pool"), F.count_if(F.col("quality") == 1).alias("selected"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("unknown")), calls(spark, d).agg(F.count("*").alias("n_calls"), F.count_if(~F.col("ok")).alias("failures")), left]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))  # one row each
    return one.withColumn("units_planned", F.col("pool") + F.col("left")).drop("left")


# ---- retrieval by budget and method ---------------------------------------------------------------------------------

REPORT_BUDGETS = (10, 40, 200)


def retrieval_report(runs: dict[str, DataFrame], qrels: dict[str, DataFrame], budgets=REPORT_BUDGETS) -> DataFrame:
    """(budget, method, metric, value): each method's metrics over the first `budget` queries, by query id, that have
    relevant documents. runs: (qid, doc_id, rank); qrels: (qid, doc_id). A query without a run counts as 0."""
    gain = lambda k: F.sum(F.when(F.col("rank") <= k, F.ln(F.lit(2.0)) / F.ln(F.col("rank") + 1.0)).otherwise(0.0))
    out = None
    for name, run in runs.items():
        hit = qrels[name].join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
        per = hit.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 10).alias("h"), F.min("rank").alias("first"), gain(10).alias("dcg")).orderBy("qid").limit(max(budgets))
        per = per.withColumn("q", F.row_number().over(Window.orderBy("qid")))  # as many rows as the largest budget
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(F.lit(2.0)) / F.ln(i + 1.0))
        long = per.withColumn("budget", F.explode(F.filter(F.array(*[F.lit(b).cast("long") for b in budgets]), lambda b: F.col("q") <= b)))
        one = long.groupBy("budget").agg(F.avg(F.col("h") / F.col("n")).alias("recall@10"), F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)).alias("mrr@10"), F.avg(F.col("dcg") / ideal).alias("ndcg@10"))
        made = one.unpivot(["budget"], ["recall@10", "mrr@10", "ndcg@10"], "metric", "value").select("budget", F.lit(name).alias("method"), "metric", R("value").alias("value"))
        out = made if out is None else out.union(made)
    return out


@query("retrieval_report", "WITH " + BM25.format(k=20) + "," + DENSE + """,
rel AS (SELECT 'bm25' AS method, item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) UNION ALL SELECT 'dense', q.vec_id, c.vec_id FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
run AS (SELECT 'bm25' AS method, qid, doc_id, rank FROM bm UNION ALL SELECT 'dense', qid, doc_id, rank FROM dr),
per AS (SELECT method, qid, count(*) AS n, count(*) FILTER (rank <= 10) AS h, min(rank) AS f, sum(CASE WHEN rank <= 10 THEN ln(2) / ln(rank + 1) ELSE 0 END) AS dcg, row_number() OVER (PARTITION BY method ORDER BY qid) AS q FROM rel LEFT JOIN run USING (method, qid, doc_id) GROUP BY method, qid),
x AS (SELECT b::BIGINT AS budget, method, avg(h / n::DOUBLE) AS r, avg(CASE WHEN f <= 10 THEN 1 / f::DOUBLE ELSE 0 END) AS m, avg(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: ln(2) / ln(i + 1)))) AS g FROM per, (SELECT unnest([10, 40, 200]) AS b) WHERE q <= b GROUP BY b, method)
SELECT budget, method, 'recall@10' AS metric, round(r, 6) AS value FROM x UNION ALL SELECT budget, method, 'mrr@10', round(m, 6) FROM x UNION ALL SELECT budget, method, 'ndcg@10', round(g, 6) FROM x""")
def _report(spark, d):
    docs, items = table(spark, d, "documents").select("doc_id", "text"), _items(spark, d)
    v = table(spark, d, "embeddings").select("vec_id", "label")
    rel = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label").join(v, "label").where("qid <> vec_id").select("qid", F.col("vec_id").alias("doc_id"))
    return retrieval_report({"bm25": bm25(docs, items), "dense": _dense(spark, d)}, {"bm25": verbatim(docs, items), "dense": rel})


# ---- audits -------------------------------------------------------------------------------------------------------------


def stratified(rows: DataFrame, id_: str, stratum: str, n: int) -> DataFrame:
    """(id, stratum) of n rows: a proportional quota a stratum, rounded half to even and capped; what is missing is
    dealt one a stratum in key order until it is gone; rows by a hash of their id. Strata are few."""
    size = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    total = size.agg(F.sum("size").alias("total"))  # one row
    q = size.crossJoin(F.broadcast(total)).withColumn("quota", F.least(F.bround(F.col("size") / F.col("total") * n, 0).cast("long"), F.col("size")))
    # round j of the top-up gives one more to every stratum with more than quota + j - 1 rows, in key order
    left = F.greatest(F.lit(0), F.lit(n) - F.sum("quota").over(Window.partitionBy()))
    room = q.withColumn("left", left).withColumn("j", F.explode_outer(F.when((F.col("left") > 0) & (F.col("size") > F.col("quota")), F.sequence(F.lit(1).cast("long"), F.least(F.col("left"), F.col("size") - F.col("quota"))))))
    turn = room.withColumn("turn", F.when(F.col("j").isNotNull(), F.row_number().over(Window.orderBy(F.col("j").isNull(), "j", stratum))))
    quota = turn.groupBy(stratum).agg((F.first("quota") + F.count_if(F.col("turn") <= F.col("left"))).alias("quota"))
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(id_).cast("string")), id_))
    return rows.select(id_, stratum).withColumn("r", r).where(F.col("r") <= n).join(F.broadcast(quota), stratum).where("r <= quota").orderBy(F.md5(F.col(id_).cast("string")), id_).limit(n).select(id_, stratum)


@query("audit_top_up", """WITH s AS (SELECT source, count(*) AS size, least(round_even(count(*) * 37::DOUBLE / (SELECT count(*) FROM documents), 0)::BIGINT, count(*)) AS quota FROM documents GROUP BY source),
l AS (SELECT *, greatest(0, 37 - (SELECT sum(quota) FROM s)) AS remain FROM s),
j AS (SELECT source, remain, row_number() OVER (ORDER BY j, source) AS turn FROM (SELECT source, remain, unnest(range(1, least(remain, size - quota)::BIGINT + 1)) AS j FROM l)),
q AS (SELECT source, quota + (SELECT count(*) FROM j WHERE j.source = l.source AND turn <= j.remain) AS quota FROM l),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents)
SELECT doc_id, source FROM r JOIN q USING (source) WHERE r <= quota ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 37""")
def _top_up(spark, d):
    return stratified(table(spark, d, "documents"), "doc_id", "source", 37)


MIX = 50


@query("audit_ecb_mix", f"""WITH {PRED}, p AS (SELECT conv_id, turn, kind, md5(conv_id || ':' || turn) AS h FROM pred WHERE kind <> 'answer'),
n AS (SELECT least(count(*) FILTER (kind = 'near_miss'), 10) AS nm, count(*) FILTER (kind = 'canonical') AS c, count(*) FILTER (kind = 'paraphrase') AS pa FROM p),
q AS (SELECT nm, least(c, ({MIX} - nm) // 2) AS c, least(pa, {MIX} - nm - least(c, ({MIX} - nm) // 2)) AS pa FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, conv_id, turn) AS r FROM p),
k AS (SELECT conv_id, turn, kind, h, r <= CASE kind WHEN 'near_miss' THEN nm WHEN 'canonical' THEN c ELSE pa END AS picked FROM r, q),
o AS (SELECT *, row_number() OVER (ORDER BY picked DESC, h, conv_id, turn) AS place FROM k)
SELECT conv_id, turn, kind FROM o WHERE place <= {MIX}""")
def _mix(spark, d):
    """A fifth near-misses, the rest half canonical and half paraphrases, topped up from what is left, by hash."""
    p = predictions(spark, d).where("kind <> 'answer'").select("conv_id", "turn", "kind", F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))).alias("h"))
    n = p.agg(F.least(F.count_if(F.col("kind") == "near_miss"), F.lit(MIX // 5)).alias("nm"), F.count_if(F.col("kind") == "canonical").alias("c"), F.count_if(F.col("kind") == "paraphrase").alias("pa"))
    half = F.least(F.col("c"), F.floor((MIX - F.col("nm")) / 2))
    q = n.select("nm", half.alias("c"), F.least(F.col("pa"), MIX - F.col("nm") - half).alias("pa"))  # one row
    r = F.row_number().over(Window.partitionBy("kind").orderBy("h", "conv_id", "turn"))
    first = p.withColumn("r", r).where(F.col("r") <= MIX)  # no kind gives more, so that each partition keeps that many
    quota = F.when(F.col("kind") == "near_miss", F.col("nm")).when(F.col("kind") == "canonical", F.col("c")).otherwise(F.col("pa"))
    picked = first.crossJoin(F.broadcast(q)).withColumn("picked", F.col("r") <= quota)
    return picked.orderBy(F.desc("picked"), "h", "conv_id", "turn").limit(MIX).select("conv_id", "turn", "kind")


@query("audit_sheet", f"WITH {PRED}, c AS (SELECT conv_id, turn, text FROM pred JOIN conversations USING (conv_id, turn) WHERE kind = 'canonical') SELECT p.conv_id, p.turn, p.kind, coalesce(c.text, '') AS canonical_question, CASE WHEN length(t.text) > 200 THEN substr(t.text, 1, 200) || '…' ELSE t.text END AS question, '' AS fill_notes FROM pred p JOIN conversations t USING (conv_id, turn) LEFT JOIN c ON c.conv_id = p.conv_id WHERE p.kind = 'paraphrase'")
def _sheet(spark, d):
    """Rows for people to fill in, each beside its canonical question."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    p = predictions(spark, d).select("conv_id", "turn", "kind").join(t, ["conv_id", "turn"])
    c = p.where("kind = 'canonical'").select("conv_id", F.col("text").alias("canonical_question"))
    out = p.where("kind = 'paraphrase'").join(c, "conv_id", "left")
    return out.select("conv_id", "turn", "kind", F.coalesce("canonical_question", F.lit("")).alias("canonical_question"), X.truncated(F.col("text"), 200).alias("question"), F.lit("").alias("fill_notes"))


EVIDENCE = 4000  # characters of an evidence text that a person is shown


def evidence_texts(items: DataFrame, passages: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """items (item, evidence: passage ids) with evidence as an array of (passage_id, text), in the item's own order.

    passages (passage_id, text); blank ids are none, of a repeated id the largest text counts. An id without a passage, and a null
    one, has an empty text; a longer text than `most` is cut there and ends in an ellipsis. Items are told apart by
    `item`; no evidence is an empty list. A passage that many items cite is dealt over tasks."""
    cited = written(items.select("item", F.posexplode("evidence").alias("i", "passage_id")), "cited")
    texts = passages.where("trim(passage_id) <> ''").groupBy("passage_id").agg(F.max(X.truncated(F.col("text"), most)).alias("text"))
    named = cited.where("passage_id IS NOT NULL")
    used = named.groupBy("passage_id").agg(F.count("*").alias("n")).join(texts, "passage_id", "left")
    found = spread_join(named, used, ["passage_id"], cited.count(), by="item").unionByName(cited.where("passage_id IS NULL"), allowMissingColumns=True)
    listed = found.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("i", "passage_id", F.coalesce("text", F.lit("")).alias("text")))).alias("e"))
    plain = F.transform("e", lambda x: F.struct(x["passage_id"].alias("passage_id"), x["text"].alias("text")))
    none = F.array().cast("array<struct<passage_id:string,text:string>>")
    return items.drop("evidence").join(listed.select("item", plain.alias("evidence")), "item", "left").withColumn("evidence", F.coalesce("evidence", none))


SLICE = 2 << 30  # bytes of evidence texts, about, that are on their way to items at a time


def evidence_slices(items: DataFrame, passages: DataFrame, most: int = EVIDENCE) -> list[DataFrame]:
    """evidence_texts of all items, in parts of about SLICE bytes of texts, for results that are made and written part by part.

    A text travels once for each item that cites it, so that all together are many times the passages. Every item is in one part."""
    named = items.select(F.explode("evidence").alias("passage_id")).groupBy("passage_id").agg(F.count("*").alias("n"))
    sizes = passages.groupBy("passage_id").agg(F.max(F.octet_length(X.truncated(F.col("text"), most))).alias("bytes"))
    total = named.join(sizes, "passage_id").agg(F.sum(F.col("n") * F.col("bytes")).alias("bytes")).first()["bytes"] or 0
    n = max(1, -(-int(total) // SLICE))
    return [evidence_texts(items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i), passages, most) for i in range(n)]


@query("audit_evidence", f"""WITH e AS (SELECT l_orderkey AS item, string_agg(l_partkey || '=' || CASE WHEN length(text) > {EVIDENCE} THEN substr(text, 1, {EVIDENCE}) || '…' ELSE coalesce(text, '') END, '|' ORDER BY l_linenumber, l_partkey) AS said, count(*) AS n, count(doc_id) AS n_found
FROM lineitem LEFT JOIN (SELECT doc_id, max(text) AS text FROM documents GROUP BY doc_id) ON doc_id = l_partkey GROUP BY 1) SELECT o_orderkey AS item, coalesce(n, 0) AS n, md5(coalesce(said, '')) AS said FROM orders LEFT JOIN e ON item = o_orderkey""")
def _audit_evidence(spark, d):
    """Audit rows with the texts of their evidence: orders citing the documents of their parts' numbers, some of them unknown."""
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    cites = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.transform(order, lambda x: x["l_partkey"].cast("string")).alias("evidence"))
    items = written(table(spark, d, "orders").select(F.col("o_orderkey").alias("item")).join(cites, "item", "left"), "items")
    said = F.array_join(F.transform("evidence", lambda e: F.concat(e["passage_id"], F.lit("="), e["text"])), "|")
    out = None
    for part in evidence_slices(items, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), "text")):
        done = written(part.select("item", F.size("evidence").cast("long").alias("n"), F.md5(said).alias("said")), "said")
        out = done if out is None else out.union(done)
    return out


@query("evidence_list", f"WITH {QA} SELECT o_orderkey AS item, string_agg(p_brand, '|' ORDER BY l_linenumber, l_partkey) AS units FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def _evidence_list(spark, d):
    """An item's evidence with its metadata, in the item's own order."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pid"))
    j = e.join(table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("unit")), "pid").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("item")), "item", "left_semi")
    return j.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "pid", "unit"))), lambda x: x["unit"]), "|").alias("units"))


@query("pool_rescored", "SELECT doc_id, coalesce(quality = 1, false) AS ctx, coalesce(toxic = 1, false) AS cb, coalesce(toxic = 0 AND quality = 1, false) AS unknown, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def _rescored(spark, d):
    """A pool with another model's flags; what that model did not score has none."""
    l = table(spark, d, "labels").withColumn("found", F.lit(True))
    j = table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select("doc_id", no(F.col("quality") == 1).alias("ctx"), no(F.col("toxic") == 1).alias("cb"), no((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("unknown"), F.col("found").isNull().alias("missing"))


@query("answers_by_key", "SELECT conv_id, max(CASE WHEN turn = 0 THEN md5(text) END) AS cb, max(CASE WHEN turn = 1 THEN md5(text) END) AS ctx, max(CASE WHEN turn = 2 THEN md5(text) END) AS equiv FROM conversations GROUP BY conv_id")
def _by_key(spark, d):
    """The answers of an example under its composed keys, side by side."""
    c = table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("|"), F.col("turn").cast("string")).alias("custom_id"), F.md5("text").alias("body"))
    key = F.split("custom_id", r"\|")
    one = lambda k: F.max(F.when(F.get(key, F.lit(1)) == str(k), F.col("body")))
    return c.groupBy(F.get(key, F.lit(0)).cast("long").alias("conv_id")).agg(one(0).alias("cb"), one(1).alias("ctx"), one(2).alias("equiv"))


@query("mined_texts", "SELECT doc_id, length(text) AS n FROM documents SEMI JOIN labels USING (doc_id) WHERE coalesce(text, '') <> ''")
def _mined_texts(spark, d):
    docs = table(spark, d, "documents").where("coalesce(text, '') <> ''")
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("n"))


FORMATTED = r"""
WITH v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN NULL ELSE round(value, 2) END AS value, event_id * CASE WHEN event_id % 2 = 0 THEN 500 ELSE 1 END AS n, event_type || '_50%&$#\' || event_type AS t FROM events)
SELECT event_id, CASE WHEN value IS NULL OR NOT isfinite(value) THEN '--' ELSE format('{:.2f}', value) END AS rate, CASE WHEN n >= 1000 AND n % 1000 = 0 THEN (n // 1000)::VARCHAR || 'k' ELSE n::VARCHAR END AS k,
  replace(replace(replace(replace(replace(t, '\', '\textbackslash{}'), '&', '\&'), '%', '\%'), '_', '\_'), '#', '\#') AS escaped FROM v"""


@query("formatted", FORMATTED)
def _formatted(spark, d):
    """Rates that are missing or not finite, counts in thousands where they are whole, and every character that is escaped."""
    e, odd = table(spark, d, "events"), F.col("event_id") % 7
    value = F.when(odd == 0, F.lit(float("inf"))).when(odd == 1, F.lit(float("-inf"))).when(odd == 2, F.lit(float("nan"))).when(odd == 3, F.lit(None).cast("double")).otherwise(F.round("value", 2))
    n = F.col("event_id") * F.when(F.col("event_id") % 2 == 0, 500).otherwise(1)
    t = F.concat("event_type", F.lit("_50%&$#\\"), "event_type")
    return e.select("event_id", fmt_rate(value).alias("rate"), fmt_k(n).alias("k"), latex_escape(t).alias("escaped"))


def fmt_rate(c: Column, digits: int = 2) -> Column:
    """A rate with a fixed number of digits; -- for one that is missing or not finite."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "--").otherwise(F.format_string(f"%.{digits}f", c))


def fmt_k(c: Column) -> Column:
    """Whole thousands as 5k, any other number as it is."""
    return F.when((c >= 1000) & (c % 1000 == 0), F.concat((c / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(c.cast("string"))


def latex_escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\textbackslash{}")), "([&%_#])", r"\\$1")


def latex_table(rows: DataFrame, caption: str = "") -> str:
    """A report of a few rows as a LaTeX table, on the driver; rates are rendered by fmt_rate, nulls as --."""
    numbers = {f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")}
    cells = rows.select(*[F.coalesce(fmt_rate(F.col(c), 3) if c in numbers else latex_escape(F.col(c).cast("string")), F.lit("--")).alias(c) for c in rows.columns]).collect()
    lines = [" & ".join(c.replace("_", r"\_") for c in rows.columns) + r" \\", r"\midrule", *(" & ".join(r) + r" \\" for r in cells)]
    return "\n".join([r"\begin{table}", r"\begin{tabular}{" + "l" * len(rows.columns) + "}", r"\toprule", *lines, r"\bottomrule", r"\end{tabular}", *([rf"\caption{{{caption}}}"] if caption else []), r"\end{table}"])


# ---- pairs and sources ------------------------------------------------------------------------------------------------

PAIRS = rf"w AS (SELECT item_id AS id, list_distinct(list_filter(string_split({MATCH.format('text')}, ' '), lambda x: x <> '')) AS s FROM benchmark)"


def jaccard_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b, of every two rows (id, s: a set of words) that share a word.

    Shared words are counted by an equi-join on words, never by comparing sets pair by pair. The rows of a common
    word are dealt into blocks, and each block meets all of them in a task of its own. The cost is the number of
    pairs that share a word, which is what is returned."""
    t = stable(rows.select("id", F.size("s").alias("n"), F.explode("s").alias("word")))
    count = t.groupBy("word").agg(F.count("*").alias("c")).where("c > 1").withColumn("rows", F.col("c"))
    sized = stable(spread_join(t, count, ["word"], t.count(), "rows", by="id").withColumn("blocks", F.ceil(F.col("c") / HOT)).drop("c"))
    one = sized.select(F.col("id").alias("a"), F.col("n").alias("na"), "word", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    other = sized.select(F.col("id").alias("b"), F.col("n").alias("nb"), "word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    shared = one.join(other, ["word", "block"]).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("i"))
    return shared.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard"))


@query("jaccard_pairs", f"WITH {PAIRS}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb FROM w a JOIN w b ON a.id < b.id) SELECT a, b, round(i / (na + nb - i)::DOUBLE, 6) AS jaccard FROM p WHERE i > 0")
def _pairs(spark, d):
    return jaccard_pairs(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), X.word_set(F.col("text")).alias("s"))).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


MULTI_HOP = 0.25


def plan_sources(passages: DataFrame, rate: float = MULTI_HOP, salt: str = "run") -> DataFrame:
    """(id, partner, tier): every passage (id, unit, doc, s) as a source of its own, and for `rate` of them one more with a partner.

    A partner comes from the passage's unit if that has others, else from its document, else from all: of the ten
    most similar by words one is drawn by hash; where no peer in unit or document shares a word, of all its peers.
    Without any candidate there is no second source. A null unit or document has no peers; a null text no words."""
    p = stable(passages.select("id", "unit", "doc", F.coalesce("s", F.array().cast("array<string>")).alias("s")))
    want = p.where(drawn(F.col("id"), rate, salt)).select("id")
    pick = F.conv(F.substring(F.md5(F.concat(F.lit("pick" + salt), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")

    def alike(ask: DataFrame, on: Column, tier: str) -> DataFrame:
        """One of the ten most similar peers, for those that have one."""
        rows = p.join(ask.withColumn("asked", F.lit(True)), "id", "left").select(on.alias("g"), "id", "asked", "s").where("g IS NOT NULL")
        top = similar_topk(rows)
        of = F.count("*").over(Window.partitionBy("id"))
        return top.withColumn("of", of).where(F.col("rank") == F.pmod(pick, F.col("of")) + 1).select("id", F.col("peer").alias("partner"), F.lit(tier).alias("tier"))

    def anyone(ask: DataFrame, on: str, tier: str) -> DataFrame:
        """One of all peers, drawn by its place among them: no pairs are formed."""
        at = stable(places(p.where(F.col(on).isNotNull()).select(F.col(on).alias("g"), "id")))
        own = at.join(ask, "id").where("size > 1")
        r = F.pmod(pick, F.col("size") - 1) + 1
        chosen = own.select("g", "id", (r + (r >= F.col("place")).cast("long")).alias("place"))
        return chosen.join(at.select("g", F.col("id").alias("partner"), "place"), ["g", "place"]).select("id", "partner", F.lit(tier).alias("tier"))

    out, rest = p.select("id", F.lit(None).cast(p.schema["id"].dataType).alias("partner"), F.lit("single").alias("tier")), want
    for tier in ("unit", "doc"):
        near = stable(alike(rest, F.col(tier), tier))
        rest = stable(rest.join(near, "id", "left_anti"))
        other = stable(anyone(rest, tier, tier))
        rest = stable(rest.join(other, "id", "left_anti"))
        out = out.union(near).union(other)
    return out.union(alike(rest, F.lit("all"), "all"))


@query("multihop_sources", rf"""
WITH p AS (SELECT item_id AS id, CASE WHEN item_id % 5 < 2 THEN 'u' || (item_id % 7) END AS unit, CASE WHEN item_id % 5 < 4 THEN 'd' || (item_id % 4) END AS doc, list_distinct(list_filter(string_split({MATCH.format('text')}, ' '), lambda x: x <> '')) AS s FROM benchmark),
want AS (SELECT * FROM p WHERE ('0x' || substr(md5('run' || id::VARCHAR), 1, 8))::BIGINT < 1073741824),
j AS (SELECT a.id, b.id AS peer, a.unit = b.unit AS u, a.doc = b.doc AS d, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb FROM want a JOIN p b ON a.id <> b.id),
t AS (SELECT id, peer, CASE WHEN i > 0 THEN i / (na + nb - i)::DOUBLE ELSE 0 END AS sim, CASE WHEN bool_or(coalesce(u, false)) OVER w THEN 'unit' WHEN bool_or(coalesce(d, false)) OVER w THEN 'doc' ELSE 'all' END AS tier, u, d FROM j WINDOW w AS (PARTITION BY id)),
k AS (SELECT id, peer, sim, tier FROM t WHERE (tier = 'unit' AND u) OR (tier = 'doc' AND d) OR (tier = 'all' AND sim > 0)),
r AS (SELECT *, max(sim) OVER w AS best, count(*) FILTER (sim > 0) OVER w AS alike, count(*) OVER w AS n, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, peer) AS r FROM k WINDOW w AS (PARTITION BY id))
SELECT id, NULL::BIGINT AS partner, 'single' AS tier FROM p UNION ALL
SELECT id, peer, tier FROM r WHERE r = ('0x' || substr(md5('pickrun' || id::VARCHAR), 1, 8))::BIGINT % (CASE WHEN best > 0 THEN least(10, alike) ELSE n END) + 1""")
def _sources(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), F.when(F.col("item_id") % 5 < 2, F.concat(F.lit("u"), F.col("item_id") % 7)).alias("unit"), F.when(F.col("item_id") % 5 < 4, F.concat(F.lit("d"), F.col("item_id") % 4)).alias("doc"), X.word_set(F.col("text")).alias("s"))
    return plan_sources(b)
