"""Coverage, budgets, usage accounting, robustness, audits and incremental operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.catalog import query
from lodestone.plans.joins import running_sum
from lodestone.plans.tables import table

R = lambda c, n=6: F.round(c, n)


def p_index(values, q: float):
    """The value at max(0, int(q * n) - 1) of the sorted values."""
    return F.element_at(F.array_sort(values), F.greatest(F.lit(1), F.floor(F.size(values) * F.lit(q)).cast("int")))


def qa_evidence(spark, d) -> DataFrame:
    """(item, rank, reason, unknown, pid, unit): orders as items, their parts as evidence, brands as units."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.lower(F.trim("o_orderpriority")).alias("reason"), (F.col("o_orderstatus") == "F").alias("unknown"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("pid"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("unit"))
    return o.join(e, "item").join(p, "pid", "left")


QA = """qa AS (SELECT o_orderkey AS item, lower(trim(o_orderpriority)) AS reason, o_orderstatus = 'F' AS unknown, l_partkey AS pid, p_brand AS unit
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey)"""


@query("doccov", f"WITH {QA} SELECT (SELECT count(DISTINCT pid) FROM qa) AS covered, (SELECT count(*) FROM part) AS passages, round((SELECT count(DISTINCT pid) FROM qa)::DOUBLE / (SELECT count(*) FROM part), 6) AS doccov")
def _doccov(spark, d):
    n = qa_evidence(spark, d).agg(F.countDistinct("pid").alias("covered"))
    p = table(spark, d, "part").agg(F.count("*").alias("passages"))  # one row each
    return n.crossJoin(F.broadcast(p)).select("covered", "passages", R(F.col("covered") / F.col("passages")).alias("doccov"))


@query("unitcov", f"WITH {QA} SELECT (SELECT count(DISTINCT unit) FROM qa WHERE unknown) AS covered, (SELECT count(DISTINCT p_brand) FROM part) AS units")
def _unitcov(spark, d):
    n = qa_evidence(spark, d).where("unknown").agg(F.countDistinct("unit").alias("covered"))
    return n.crossJoin(F.broadcast(table(spark, d, "part").agg(F.countDistinct("p_brand").alias("units"))))


@query("reason_set", f"WITH {QA} SELECT reason, count(DISTINCT item) AS items, round(avg(unknown::INT), 6) AS unknown_frac FROM qa GROUP BY reason")
def _reasons(spark, d):
    return qa_evidence(spark, d).groupBy("reason").agg(F.countDistinct("item").alias("items"), R(F.avg(F.col("unknown").cast("int"))).alias("unknown_frac"))


BUDGETS = (100, 500, 1000, 5000)


@query("coverage_by_budget", f"""WITH {QA}, r AS (SELECT o_orderkey AS item, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders),
f AS (SELECT pid, min(rank) AS first FROM qa JOIN r USING (item) GROUP BY pid)
SELECT b AS budget, count(first) AS covered FROM (SELECT unnest([100, 500, 1000, 5000])::BIGINT AS b) LEFT JOIN f ON first <= b GROUP BY b""")
def _by_budget(spark, d):
    """Each passage counts once, at the rank that first covers it: rows, not rows times budgets. Only the items
    within the largest budget are ranked, so the window and the broadcast hold that many rows."""
    within = table(spark, d, "orders").select(F.col("o_orderkey").alias("item")).orderBy("item").limit(BUDGETS[-1])
    ranked = within.withColumn("rank", F.row_number().over(Window.orderBy("item")))
    first = qa_evidence(spark, d).join(F.broadcast(ranked), "item").groupBy("pid").agg(F.min("rank").alias("first"))
    flags = [F.count_if(F.col("first") <= b).alias(str(b)) for b in BUDGETS]
    return first.agg(*flags).unpivot([], [str(b) for b in BUDGETS], "budget", "covered").select(F.col("budget").cast("long").alias("budget"), "covered")


@query("first_cover_curve", f"""WITH {QA}, f AS (SELECT pid, min(item) AS first FROM qa GROUP BY pid), n AS (SELECT first, count(*) AS new FROM f GROUP BY first)
SELECT first AS item, new AS newly_covered, sum(new) OVER (ORDER BY first)::BIGINT AS covered FROM n""")
def _curve(spark, d):
    first = qa_evidence(spark, d).groupBy("pid").agg(F.min("item").alias("first"))
    n = first.groupBy(F.col("first").alias("item")).agg(F.count("*").alias("newly_covered"))
    return running_sum(n, ["item"], "newly_covered", "covered")


CALLS = """calls AS (SELECT event_id, event_type AS ns, 'm' || (user_id % 3) AS model, event_type <> 'error' AS ok, value AS elapsed, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens FROM events)"""


def calls(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("ns"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).cast("long").alias("tokens"))


@query("usage_rollup", f"WITH {CALLS} SELECT CASE WHEN grouping(ns) = 0 THEN 'ns' WHEN grouping(model) = 0 THEN 'model' ELSE 'all' END AS level, coalesce(ns, model, '') AS key, count(*) AS n_calls, sum(tokens)::BIGINT AS tokens FROM calls GROUP BY GROUPING SETS ((), (ns), (model))")
def _usage(spark, d):
    g = calls(spark, d).groupingSets([[], ["ns"], ["model"]], "ns", "model").agg(F.count("*").alias("n_calls"), F.sum("tokens").alias("tokens"), F.grouping("ns").alias("gn"), F.grouping("model").alias("gm"))
    return g.select(F.when(F.col("gn") == 0, "ns").when(F.col("gm") == 0, "model").otherwise("all").alias("level"), F.coalesce("ns", "model", F.lit("")).alias("key"), "n_calls", "tokens")


@query("call_counts", f"WITH {CALLS} SELECT ns, model, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_fail FROM calls GROUP BY ns, model")
def _calls(spark, d):
    return calls(spark, d).groupBy("ns", "model").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_fail"))


@query("errors_by_code", f"""WITH {CALLS}, e AS (SELECT model, coalesce(nullif(regexp_extract('HTTP ' || (['429','500','404'])[event_id % 3 + 1], 'HTTP (400|401|403|404|405|429|500)', 1), ''), 'other') AS code FROM calls WHERE NOT ok)
SELECT coalesce(model, 'all') AS model, code, count(*) AS n FROM e GROUP BY GROUPING SETS ((code), (model, code))""")
def _errors(spark, d):
    text = F.concat(F.lit("HTTP "), F.element_at(F.array(*map(F.lit, ("429", "500", "404"))), (F.col("event_id") % 3 + 1).cast("int")))
    code = F.coalesce(F.nullif(F.regexp_extract(text, "HTTP (400|401|403|404|405|429|500)", 1), F.lit("")), F.lit("other"))
    e = calls(spark, d).where(~F.col("ok")).select("model", code.alias("code"))
    return e.groupingSets([["code"], ["model", "code"]], "model", "code").agg(F.count("*").alias("n")).select(F.coalesce("model", F.lit("all")).alias("model"), "code", "n")


@query("token_breakdown", f"WITH {CALLS} SELECT CASE ns WHEN 'click' THEN 'read' WHEN 'view' THEN 'read' ELSE 'other' END AS bucket, sum(tokens)::BIGINT AS tokens FROM calls GROUP BY 1 HAVING sum(tokens) > 0")
def _breakdown(spark, d):
    return calls(spark, d).groupBy(F.when(F.col("ns").isin("click", "view"), "read").otherwise("other").alias("bucket")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


@query("stats_p90", f"WITH {CALLS} SELECT ns, count(*) AS n, round(avg(elapsed), 6) AS mean, round(median(elapsed), 6) AS median, round(list_sort(list(elapsed))[greatest(1, floor(count(*) * 0.9::DOUBLE)::INT)], 6) AS p90, round(min(elapsed), 6) AS min, round(max(elapsed), 6) AS max FROM calls GROUP BY ns")
def _stats(spark, d):
    r = ranked_values(calls(spark, d).select("ns", "elapsed"), "ns", "elapsed")
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("elapsed")))
    n = F.col("n")
    mid = (at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2
    out = r.groupBy("ns", "n").agg((F.sum(F.col("elapsed") * F.col("c")) / F.first("n")).alias("mean"), mid.alias("median"), at(F.greatest(F.lit(1), F.floor(n * 0.9).cast("int"))).alias("p90"), F.min("elapsed").alias("min"), F.max("elapsed").alias("max"))
    return out.select("ns", "n", *[R(c).alias(c) for c in ("mean", "median", "p90", "min", "max")])


def ranked_values(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, c, n, upto): each value of a group with its count, the group's, and how many are not above it.

    Equal values are counted before they are sorted, the sort is by ranges over all groups, and ranks come from
    prefix sums: no task gathers or sorts a group. Groups are few. A null group is a group."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("c"))
    run = running_sum(counted, [group, value], "c", "all_upto")
    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    base = run.groupBy(F.col(group).alias("g")).agg(F.min(F.col("all_upto") - F.col("c")).alias("base"))
    some = F.broadcast(sizes.join(base, sizes.g.eqNullSafe(base.g)).select(sizes.g, "n", "base"))  # a row a group
    return run.join(some, F.col(group).eqNullSafe(F.col("g"))).select(group, value, "c", "n", (F.col("all_upto") - F.col("base")).alias("upto"))


@query("ecdf", f"WITH {CALLS} SELECT ns, elapsed, round(cume_dist() OVER (PARTITION BY ns ORDER BY elapsed), 6) AS p FROM calls WHERE isfinite(elapsed)")
def _ecdf(spark, d):
    c = calls(spark, d).where(~F.isnan("elapsed") & (F.abs("elapsed") != float("inf"))).select("ns", "elapsed")
    r = ranked_values(c, "ns", "elapsed").select("ns", "elapsed", R(F.col("upto") / F.col("n")).alias("p"), "c")
    return r.withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), "c"))).drop("c")


@query("flags_metrics", "SELECT source, count(*) AS n, round(avg(toxic), 6) AS cb_acc, round(avg(quality), 6) AS ctx_acc, round(avg((toxic = 0 AND quality = 1)::INT), 6) AS unknown_purity FROM labels JOIN documents USING (doc_id) GROUP BY source")
def _flags(spark, d):
    f = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return f.groupBy("source").agg(F.count("*").alias("n"), R(F.avg("toxic")).alias("cb_acc"), R(F.avg("quality")).alias("ctx_acc"), R(F.avg(((F.col("toxic") == 0) & (F.col("quality") == 1)).cast("int"))).alias("unknown_purity"))


PRED = """pred AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'near_miss' WHEN turn = min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AND role = 'user' THEN 'canonical' WHEN role = 'user' THEN 'paraphrase' ELSE 'answer' END AS kind,
  length(text) % 2 = 0 AS correct, length(text) % 3 = 0 AS abstain, (length(text) % 101) / 100::DOUBLE AS confidence, md5(text) AS answer FROM conversations)"""


def predictions(spark, d) -> DataFrame:
    c, n = table(spark, d, "conversations"), F.length("text")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    kind = F.when(F.col("role") == "system", "near_miss").when((F.col("role") == "user") & (F.col("turn") == first), "canonical").when(F.col("role") == "user", "paraphrase").otherwise("answer")
    return c.select("conv_id", "turn", kind.alias("kind"), (n % 2 == 0).alias("correct"), (n % 3 == 0).alias("abstain"), ((n % 101) / 100.0).alias("confidence"), F.md5("text").alias("answer"))


@query("ecb_accuracy", f"WITH {PRED} SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM pred GROUP BY GROUPING SETS ((), (kind))")
def _ecb(spark, d):
    g = predictions(spark, d).groupingSets([[], ["kind"]], "kind").agg(F.count("*").alias("n"), R(F.avg(F.col("correct").cast("int"))).alias("accuracy"))
    return g.select(F.coalesce("kind", F.lit("all")).alias("kind"), "n", "accuracy")


@query("near_miss_fpr", f"WITH {PRED} SELECT count(*) AS n, round(coalesce(avg((NOT abstain)::INT), 0), 6) AS fpr FROM pred WHERE kind = 'near_miss'")
def _fpr(spark, d):
    return predictions(spark, d).where("kind = 'near_miss'").agg(F.count("*").alias("n"), R(F.coalesce(F.avg((~F.col("abstain")).cast("int")), F.lit(0.0))).alias("fpr"))


@query("paraphrase_consistency", f"WITH {PRED} SELECT count(*) AS n, count(*) FILTER (p.answer = c.answer) AS same, count(*) FILTER (p.correct AND c.correct) AS both_correct FROM pred p LEFT JOIN (SELECT * FROM pred WHERE kind = 'canonical') c USING (conv_id) WHERE p.kind = 'paraphrase'")
def _consistency(spark, d):
    p = predictions(spark, d)
    c = p.where("kind = 'canonical'").select("conv_id", F.col("answer").alias("ca"), F.col("correct").alias("cc"))
    return p.where("kind = 'paraphrase'").join(c, "conv_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == F.col("ca")).alias("same"), F.count_if(F.col("correct") & F.col("cc")).alias("both_correct"))


@query("risk_coverage", f"""WITH {PRED}, t AS (SELECT i, i / 20::DOUBLE AS t FROM range(0, 21) r(i))
SELECT i::BIGINT AS step, count(*) FILTER (NOT abstain AND confidence >= t - 1e-12) AS kept, round(count(*) FILTER (NOT abstain AND confidence >= t - 1e-12)::DOUBLE / count(*), 6) AS coverage,
  round(coalesce(1 - avg(correct::INT) FILTER (NOT abstain AND confidence >= t - 1e-12), 0), 6) AS risk FROM pred, t GROUP BY i""")
def _risk(spark, d):
    """One pass: a row falls in the highest threshold it reaches, and counts accumulate downwards."""
    p = predictions(spark, d).select(F.when(~F.col("abstain"), F.floor(F.col("confidence") * 20 + 1e-9)).otherwise(-1).cast("long").alias("step"), F.col("correct").cast("long").alias("c"))
    h = p.groupBy("step").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    steps = spark.range(-1, 21).withColumnRenamed("id", "step").join(F.broadcast(h), "step", "left")  # 22 rows at most
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.select("step", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("kept"), F.coalesce(F.sum("c").over(down), F.lit(0)).alias("good"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return out.where("step >= 0").select("step", "kept", R(F.col("kept") / F.col("all")).alias("coverage"), R(F.when(F.col("kept") > 0, 1 - F.col("good") / F.col("kept")).otherwise(0.0)).alias("risk"))


@query("answer_entropy", f"""WITH {PRED}, c AS (SELECT conv_id, answer, count(*) AS n FROM pred GROUP BY conv_id, answer), t AS (SELECT conv_id, n, sum(n) OVER (PARTITION BY conv_id) AS total FROM c)
SELECT conv_id, round(CASE WHEN max(total) <= 1 THEN 0 ELSE -sum(n / total::DOUBLE * ln(n / total::DOUBLE + 1e-12)) / ln(max(total)::DOUBLE) END, 6) + 0.0 AS entropy FROM t GROUP BY conv_id""")
def _entropy(spark, d):
    c = predictions(spark, d).groupBy("conv_id", "answer").agg(F.count("*").alias("n"))
    t = c.withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    p = F.col("n") / F.col("total")
    h = F.when(F.max("total") <= 1, F.lit(0.0)).otherwise(-F.sum(p * F.ln(p + 1e-12)) / F.ln(F.max("total").cast("double")))
    return t.groupBy("conv_id").agg((R(h) + F.lit(0.0)).alias("entropy"))


@query("resume_antijoin", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _resume(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("cache_lookup", "SELECT doc_id, quality, quality IS NOT NULL AS cached FROM documents LEFT JOIN labels USING (doc_id)")
def _cache(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("cached", F.col("quality").isNotNull())


@query("batch_retry_pending", f"WITH {CALLS}, ok AS (SELECT model || ns AS id, min(event_id) AS first FROM calls WHERE ok AND event_id % 2 = 0 GROUP BY 1) SELECT DISTINCT model || c.ns AS id, first FROM calls c LEFT JOIN ok ON ok.id = model || c.ns")
def _batch(spark, d):
    c = calls(spark, d).withColumn("id", F.concat("model", "ns"))
    first = c.where("ok AND event_id % 2 = 0").groupBy("id").agg(F.min("event_id").alias("first"))
    return c.select("id").distinct().join(first, "id", "left")


@query("union_pool", "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT item_id, 'item' FROM benchmark")
def _union(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind")).unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("kind")))


@query("except_rest", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def _except(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").where("quality = 1").select("doc_id")).distinct()


@query("audit_rates", "SELECT event_type, round(avg(CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 END), 6) AS rate, count(CASE WHEN event_id % 3 < 2 THEN 1 END) AS n_rated FROM events GROUP BY event_type")
def _audit_rates(spark, d):
    flag = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 0)
    return table(spark, d, "events").groupBy("event_type").agg(R(F.avg(flag)).alias("rate"), F.count(flag).alias("n_rated"))


@query("audit_stratified", """WITH s AS (SELECT source, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 0)::BIGINT AS quota FROM documents GROUP BY source)
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) JOIN s USING (source) WHERE r <= least(quota, n)""")
def _audit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    total = docs.agg(F.count("*").alias("total"))  # one row
    quota = docs.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("source", F.least(F.bround(F.col("n") * 100.0 / F.col("total"), 0).cast("long"), "n").alias("quota"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    first = docs.withColumn("r", r).where("r <= 100")  # no quota is larger; so each partition keeps that many of a source
    return first.join(F.broadcast(quota), "source").where("r <= quota").select("doc_id", "source")


@query("select_random", "SELECT doc_id FROM documents ORDER BY md5('7' || doc_id::VARCHAR), doc_id LIMIT 200")
def _random(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))), "doc_id").limit(200)
