"""From a model's raw answers to a pool of checked questions: parsing, scoring, filters, and the staged calls.

Answers come from a completer by way of a replay table keyed by the request, so a run over recorded answers is exact
and a rerun calls nothing twice. Every stage asks only about what the stage before it kept.
"""

from __future__ import annotations

import asyncio
import hashlib
import json
from collections.abc import Awaitable, Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.metrics_queries import PRED, predictions
from lodestone.operators.text_queries import MATCH
from lodestone.plans.catalog import query
from lodestone.plans.joins import stable
from lodestone.plans.tables import table

W_CLOSED, W_ENTROPY, W_AGREE = 1.0, 1.0, 1.0  # weights of the edge score
TAU, MAX_COPY = 0.6, 0.65
SAMPLES, PARAPHRASES = 4, 2
MODEL = "chat"


# ---- parsing what a model said -----------------------------------------------------------------------------------

FENCE = r"(?im)^```(?:json)?\s*|\s*```$"


def _between(c: Column, first: str, last: str) -> Column:
    """From the first `first` to the last `last`; null if there is no such stretch."""
    start, back = F.locate(first, c), F.locate(last, F.reverse(c))
    stop = F.length(c) - back + 1
    return F.when((start > 0) & (back > 0) & (start < stop), F.substring(c, start, stop - start + 1))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def whole_json(c: Column) -> Column:
    """A text as one JSON value, a variant; null unless the text is that value and nothing else.

    The parser stops after a first value, so the text is read inside an array that must end as it was written."""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit(', "end"]')))
    ended = (F.try_variant_get(v, "$[1]", "string") == "end") & F.try_variant_get(v, "$[2]", "variant").isNull()
    return F.when(ended, F.try_variant_get(v, "$[0]", "variant"))


def loose_json(c: Column) -> Column:
    """The JSON in an answer, as text: the whole answer without code fences, else the widest array, else the widest
    object; null if none of them parses. An array inside prose is preferred to the object around it."""
    t = strip(F.regexp_replace(strip(c), FENCE, ""))
    valid = lambda x: F.when(whole_json(x).isNotNull(), x)
    return F.coalesce(valid(t), valid(_between(t, "[", "]")), valid(_between(t, "{", "}")))


def pred_contract(c: Column) -> Column:
    """(answer, abstain, confidence) of a predicted answer.

    An empty answer abstains. A JSON object gives the three; confidence is clamped to [0, 1], 0 if it is no number;
    an answer that says it is unknown abstains, and whoever abstains answers nothing. Anything else is its first
    line, at confidence 0.5."""
    raw = strip(c)
    as_object = lambda x: F.when(F.startswith(F.schema_of_variant(whole_json(x)), F.lit("OBJECT")), whole_json(x))
    obj = F.coalesce(as_object(raw), as_object(_between(raw, "{", "}")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(obj, path, "variant"))
    said = F.try_variant_get(obj, "$.answer", "string")
    zero = F.coalesce(F.try_variant_get(obj, "$.answer", "double") == 0, F.lit(False)) & (kind("$.answer") != "STRING")
    said = F.when(said.isNull() | zero | (kind("$.answer") == "VOID"), "").when((kind("$.answer") == "BOOLEAN") & (said == "true"), "True").otherwise(said)
    held = F.try_variant_get(obj, "$.abstain", "string")
    abst = F.when(kind("$.abstain") == "STRING", held != "").when(kind("$.abstain") == "BOOLEAN", held == "true").otherwise(F.try_variant_get(obj, "$.abstain", "double") != 0)
    sure = F.try_variant_get(obj, "$.confidence", "double")
    sure = F.when(F.isnan(sure) | (F.abs(sure) == float("inf")), 0.0).otherwise(F.coalesce(sure, F.lit(0.0)))
    answer = F.when(obj.isNotNull(), said).otherwise(F.trim(F.element_at(F.split(raw, r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), 1)))
    abstain = (obj.isNotNull() & F.coalesce(abst, F.lit(False))) | X.normalize_match(answer).isin("unknown", "unanswerable", "not enough info") | (raw == "")
    confidence = F.when(raw == "", 0.0).when(obj.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure))).otherwise(0.5)
    return F.struct(F.when(abstain, "").otherwise(answer).alias("answer"), abstain.alias("abstain"), confidence.alias("confidence"))


def normalized_reason(c: Column, hops: Column | None = None) -> Column:
    """Lower-cased and trimmed; missing is `unknown`, or `multi-hop` where there are two pieces of evidence."""
    none = F.lit("unknown") if hops is None else F.when(hops >= 2, "multi-hop").otherwise("unknown")
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), none)


def inverse_agreement(c: Column) -> Column:
    """1 less an agreement clamped to [0, 1]; what is missing, NaN or infinite agrees."""
    fine = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return 1 - F.when(fine, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(1.0)


def multi_hop(evidence: Column) -> Column:
    return F.coalesce(F.size(evidence), F.lit(0)) >= 2


def needs_backfill(edge: Column, entropy: Column, agreement: Column) -> Column:
    """An edge score of exactly one, or a part of it that was never worked out."""
    return (F.abs(edge - 1) < 1e-9) | entropy.isNull() | agreement.isNull()


def near_miss_accepted(label: Column, verdict: Column) -> Column:
    return ((label == "UNANSWERABLE") & (verdict == "NOT_ENOUGH_INFO")) | ((label == "CONTRADICTED") & (verdict == "CONTRADICTED"))


def drawn(id_: Column, rate: float, salt: str) -> Column:
    """A draw by hash: the same for the same id and salt, true for `rate` of ids."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), id_.cast("string"))), 1, 8), 16, 10).cast("long") < F.lit(int(rate * (1 << 32)))


SAID = ("", '{"answer": "x", "abstain": false, "confidence": 0.75}', '{"answer": "Unknown.", "confidence": 2}', "plain words\nsecond line", '{"answer": "y", "abstain": true, "confidence": 0.5}', 'So: {"answer": "z", "confidence": -1} is it', '{"confidence": 0.25}', "not enough info")
WRAPS = ("{}", "```json\n{}\n```", "Here it is: {} as asked.", "list: [1, 2] {}", "no json", "```\n[{}]\n```")


def _of_events(spark, d, values) -> tuple[DataFrame, Column]:
    e = table(spark, d, "events")
    return e, F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


@query("loose_json_parse", rf"""
WITH s AS (SELECT event_id, trim(regexp_replace(replace(({_sql_list(WRAPS)})[event_id % {len(WRAPS)} + 1], '{{}}', props), '(?im)^```(?:json)?\s*|\s*```$', '', 'g')) AS t FROM events),
x AS (SELECT event_id, t, substr(t, strpos(t, '['), length(t) - strpos(reverse(t), ']') + 2 - strpos(t, '[')) AS a, substr(t, strpos(t, '{{'), length(t) - strpos(reverse(t), '}}') + 2 - strpos(t, '{{')) AS o FROM s)
SELECT event_id, CASE WHEN json_valid(t) THEN t WHEN contains(t, '[') AND contains(t, ']') AND json_valid(a) THEN a WHEN contains(t, '{{') AND json_valid(o) THEN o END AS json FROM x""")
def _loose(spark, d):
    e, wrap = _of_events(spark, d, WRAPS)
    return e.select("event_id", loose_json(F.replace(wrap, F.lit("{}"), F.col("props"))).alias("json"))


@query("pred_contract", f"""
WITH s AS (SELECT event_id, ({_sql_list(SAID)})[event_id % {len(SAID)} + 1] AS raw FROM events),
o AS (SELECT event_id, raw, CASE WHEN json_valid(raw) AND starts_with(raw, '{{') THEN raw WHEN contains(raw, '{{') THEN regexp_extract(raw, '\\{{.*\\}}') END AS j FROM s),
f AS (SELECT event_id, raw, CASE WHEN j IS NULL THEN string_split(raw, chr(10))[1] ELSE coalesce(json_extract_string(j, '$.answer'), '') END AS answer,
  coalesce(json_extract_string(j, '$.abstain') = 'true', false) AS abst, CASE WHEN raw = '' THEN 0 WHEN j IS NULL THEN 0.5 ELSE least(1, greatest(0, coalesce(json_extract_string(j, '$.confidence')::DOUBLE, 0))) END AS confidence FROM o),
g AS (SELECT *, abst OR raw = '' OR {MATCH.format('answer')} IN ('unknown', 'unanswerable', 'not enough info') AS abstain FROM f)
SELECT event_id, CASE WHEN abstain THEN '' ELSE answer END AS answer, abstain, confidence::DOUBLE AS confidence FROM g""")
def _contract(spark, d):
    e, said = _of_events(spark, d, SAID)
    return e.select("event_id", pred_contract(said).alias("p")).select("event_id", "p.*")


# ---- scores over recorded answers ---------------------------------------------------------------------------------

TURNS = "t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user')"
AGREE = TURNS + f""", ab AS (SELECT conv_id, {MATCH.format("max(CASE WHEN r = 2 THEN text END)")} AS x, {MATCH.format("max(CASE WHEN r = 3 THEN text END)")} AS y, count(*) FILTER (r IN (2, 3)) AS n FROM t GROUP BY conv_id),
sl AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM ab),
ag AS (SELECT conv_id, CASE WHEN n < 2 THEN 1.0 WHEN x <> '' AND y <> '' AND (x = y OR ((len(string_split(s, ' ')) >= 2 OR length(s) >= 8) AND contains(l, s))
  OR coalesce(abs(try_cast(nullif(regexp_extract(x, '[0-9]+'), '') AS DOUBLE) - try_cast(nullif(regexp_extract(y, '[0-9]+'), '') AS DOUBLE)) < 1e-9, false)) THEN 1.0 ELSE 0.0 END::DOUBLE AS agreement FROM sl)"""


def agreement(answers: Column) -> Column:
    """1 or 0 as the first two answers of an array are equivalent or not; fewer than two agree."""
    return F.when(F.size(answers) < 2, 1.0).otherwise(F.when(X.quick_equiv(F.get(answers, F.lit(0)), F.get(answers, F.lit(1))), 1.0).otherwise(0.0))


def paraphrase_agreement(spark, d) -> DataFrame:
    """(conv_id, agreement) of the two user turns after the first."""
    u = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return u.select("conv_id", agreement(F.transform(F.slice("turns", 2, 2), lambda t: F.coalesce(t["text"], F.lit("")))).alias("agreement"))


@query("paraphrase_agreement", f"WITH {AGREE} SELECT conv_id, agreement FROM ag")
def _agreement(spark, d):
    return paraphrase_agreement(spark, d)


def entropy(df: DataFrame, by: str, label: str) -> DataFrame:
    """(by, entropy): normalised entropy of a group's labels; a group of one has none."""
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    total = n.groupBy(by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    # -sum(p ln(p + 1e-12)) differs from this closed form by less than 1e-11 a label
    return total.select(by, F.when(F.col("total") <= 1, 0.0).otherwise((F.ln("total") - F.col("s") / F.col("total")) / F.ln("total")).alias("entropy"))


def edge_score(closed_book_correct: Column, h: Column, agree: Column) -> Column:
    return W_CLOSED * F.when(closed_book_correct, 0.0).otherwise(1.0) + W_ENTROPY * h + W_AGREE * (1 - agree)


EDGE = f"""WITH {PRED}, {AGREE}, cb AS (SELECT conv_id, bool_or(correct) AS ok FROM pred WHERE kind = 'canonical' GROUP BY conv_id),
c AS (SELECT conv_id, answer, count(*) AS n FROM pred WHERE kind = 'answer' GROUP BY conv_id, answer), tt AS (SELECT conv_id, sum(n) AS total, -sum(n / t * ln(n / t + 1e-12)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id)::DOUBLE AS t FROM c) GROUP BY conv_id),
e AS (SELECT conv_id, ok, CASE WHEN ok THEN 0 WHEN coalesce(total, 0) <= 1 THEN 0 ELSE h / ln(total::DOUBLE) END AS h, CASE WHEN ok THEN 1 ELSE agreement END AS a FROM cb JOIN ag USING (conv_id) LEFT JOIN tt USING (conv_id)),
s AS (SELECT conv_id, ok, (CASE WHEN ok THEN 0 ELSE 1 END + h + 1 - a)::DOUBLE AS score FROM e)"""


def _edges(spark, d) -> DataFrame:
    """Whoever answers right without evidence is not asked again: no entropy, full agreement."""
    p = predictions(spark, d)
    cb = p.where("kind = 'canonical'").groupBy("conv_id").agg(F.bool_or("correct").alias("ok"))
    e = cb.join(paraphrase_agreement(spark, d), "conv_id").join(entropy(p.where("kind = 'answer'"), "conv_id", "answer"), "conv_id", "left")
    h, a = F.when(F.col("ok"), 0.0).otherwise(F.coalesce("entropy", F.lit(0.0))), F.when(F.col("ok"), 1.0).otherwise(F.col("agreement"))
    return e.select("conv_id", "ok", h.alias("h"), a.alias("a"), edge_score(F.col("ok"), h, a).alias("score"))


@query("edge_score", EDGE + "SELECT conv_id, ok, round(score, 6) + 0.0 AS edge_score FROM s")
def _edge_score(spark, d):
    return _edges(spark, d).select("conv_id", "ok", (F.round("score", 6) + F.lit(0.0)).alias("edge_score"))


@query("edge_filter", EDGE + f"SELECT conv_id, round(score, 6) + 0.0 AS edge_score FROM s WHERE score >= {TAU}::DOUBLE")
def _edge_filter(spark, d):
    return _edges(spark, d).where(F.col("score") >= TAU).select("conv_id", (F.round("score", 6) + F.lit(0.0)).alias("edge_score"))


@query("reason_normalise", "SELECT doc_id, CASE WHEN coalesce(lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) || ' ' WHEN doc_id % 3 = 1 THEN '  ' END)), '') = '' THEN CASE WHEN doc_id % 2 = 0 THEN 'multi-hop' ELSE 'unknown' END ELSE lower(lang) END AS reason FROM documents WHERE lang IS NOT NULL")
def _reason(spark, d):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, "  ")
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", normalized_reason(said, F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).alias("reason"))


WORDS = "list_distinct(list_filter(string_split(" + MATCH + ", ' '), lambda x: x <> ''))"


@query("copy_filter", f"""
WITH w AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM conversations),
s AS (SELECT conv_id, turn, {WORDS.format('text')} AS a, {WORDS.format('span')} AS b FROM w WHERE span IS NOT NULL),
j AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b))))::DOUBLE END AS j FROM s)
SELECT conv_id, turn, round(j, 6) AS jaccard FROM j WHERE j <= {MAX_COPY}::DOUBLE""")
def _copy_filter(spark, d):
    """A turn is a question, the turn after it the span: a question too close to its span goes."""
    w = table(spark, d, "conversations").select("conv_id", "turn", "text", F.expr("lead(text) OVER (PARTITION BY conv_id ORDER BY turn)").alias("span")).where("span IS NOT NULL")
    j = w.select("conv_id", "turn", X.word_set(F.col("text")).alias("a"), X.word_set(F.col("span")).alias("b")).select("conv_id", "turn", X.jaccard(F.col("a"), F.col("b")).alias("j"))
    return j.where(F.col("j") <= MAX_COPY).select("conv_id", "turn", F.round("j", 6).alias("jaccard"))


@query("strict_sample", "SELECT doc_id FROM documents WHERE ('0x' || substr(md5('strict' || doc_id::VARCHAR), 1, 8))::BIGINT < 1073741824")
def _strict(spark, d):
    return table(spark, d, "documents").select("doc_id").where(drawn(F.col("doc_id"), 0.25, "strict"))


@query("near_miss_accept", "SELECT event_id FROM events WHERE (event_id % 3 = 0 AND event_id % 4 = 2) OR (event_id % 3 = 1 AND event_id % 4 = 1)")
def _near_miss(spark, d):
    e, label = _of_events(spark, d, ("UNANSWERABLE", "CONTRADICTED", "ANSWERABLE"))
    said = F.element_at(F.array(*map(F.lit, ("ENTAILED", "It is contradicted", "Not enough info.", "Maybe"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.where(near_miss_accepted(label, X.verdict(said))).select("event_id")


@query("backfill_predicate", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE abs(coalesce(quality, 0) - 1) < 1e-9 OR toxic IS NULL")
def _backfill(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.where(needs_backfill(F.coalesce("quality", F.lit(0)), F.col("toxic"), F.lit(1))).select("doc_id")


# ---- requests, replay and completion ------------------------------------------------------------------------------

REQUEST = "key string, ns string, model string, system string, user string, temperature double, max_tokens int"
ANSWER = "key string, content string, error string"
Completer = Callable[[pd.DataFrame], pd.DataFrame]  # rows of REQUEST -> rows of ANSWER


def request_key(ns: Column, model: Column, system: Column, user: Column, temperature: Column, max_tokens: Column) -> Column:
    """SHA-256 of the request as JSON with sorted keys: equal requests of a namespace have one key."""
    message = lambda role, c: F.struct(c.alias("content"), F.lit(role).alias("role"))
    req = F.struct(max_tokens.alias("max_tokens"), F.array(message("system", system), message("user", user)).alias("messages"), model.alias("model"), temperature.alias("temperature"))
    return F.sha2(F.to_json(F.struct(ns.alias("ns"), req.alias("req"))), 256)


def ask(df: DataFrame, id_: str, ns: Column, system: str, user: Column, temperature: float = 0.0, max_tokens: int = 64, model: str = MODEL) -> DataFrame:
    """(id, key, ns, model, system, user, temperature, max_tokens): one request a row of df."""
    parts = {"ns": ns, "model": F.lit(model), "system": F.lit(system), "user": user, "temperature": F.lit(float(temperature)), "max_tokens": F.lit(max_tokens)}
    return df.select(F.col(id_).alias("id"), request_key(**parts).alias("key"), *[c.alias(k) for k, c in parts.items()])


class Concurrent:
    """A completer that keeps up to `limit` requests of a task in flight at once.

    `one` is a coroutine from a request's fields to the text of its answer. A request that takes more than `timeout` seconds, or
    raises, becomes an error row; the others go on. Requests are started as Arrow batches come in and answers passed on
    as they are ready, so a task holds a batch of requests, `limit` of them started, and `batch` answers, whatever
    the number of its rows."""

    def __init__(self, one: Callable[[dict], Awaitable[str]], limit: int = 16, timeout: float = 60.0, batch: int = 256):
        self.one, self.limit, self.timeout, self.batch = one, limit, timeout, batch

    async def _answer(self, request: dict) -> tuple:
        try:
            return request["key"], await asyncio.wait_for(self.one(request), self.timeout), None
        except TimeoutError:
            return request["key"], None, "timeout"
        except Exception as e:  # a failed call is a row of the log, not the end of the job
            return request["key"], None, f"{type(e).__name__}: {e}"

    def stream(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.to_dict("records"))
        loop, flying, ready = asyncio.new_event_loop(), set(), []
        try:
            while True:
                flying |= {loop.create_task(self._answer(r)) for r in islice(rows, self.limit - len(flying))}
                if not flying:
                    break
                done, flying = loop.run_until_complete(asyncio.wait(flying, return_when=asyncio.FIRST_COMPLETED))
                ready += [t.result() for t in done]
                if len(ready) >= self.batch:
                    yield pd.DataFrame(ready, columns=["key", "content", "error"])
                    ready = []
        finally:
            for t in flying:
                t.cancel()
            if flying:
                loop.run_until_complete(asyncio.wait(flying))
            loop.close()
        if ready:
            yield pd.DataFrame(ready, columns=["key", "content", "error"])

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame([], columns=["key", "content", "error"]), *self.stream(iter([batch]))], ignore_index=True)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """A replay table (key, content, error, at) of JSON lines that were appended call by call; `at` is their order."""
    rows = spark.read.schema(f"{ANSWER}, _corrupt_record string").json(path).where("_corrupt_record IS NULL AND key IS NOT NULL")
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select("key", "content", "error", at.alias("at"))


def last_answers(replay: DataFrame) -> DataFrame:
    """(key, content): one answer a key of a replay table in which keys repeat, the last without an error.

    The order is that of the column `at`, where there is one; else the largest content counts, so that reruns agree."""
    order = F.struct(*(["at"] if "at" in replay.columns else []), "content")
    good = replay.where("error IS NULL AND content IS NOT NULL")
    return good.groupBy("key").agg(F.max(order).getField("content").alias("content"))


class Client:
    """Answers requests from a replay table (key, content, error) first, and from a completer where it has none.

    The replay table may hold a key many times (see last_answers). New answers are kept, errors are not, so that a rerun asks again only what failed. `calls` is the log of what was
    asked: (ns, key, hit, ok)."""

    def __init__(self, replay: DataFrame, completer: Completer | None = None):
        self.replay, self.completer, self.calls = replay, completer, None
        self.known = last_answers(replay)

    def answer(self, requests: DataFrame) -> DataFrame:
        """(id, ns, content): a row for each request that was answered."""
        requests = stable(requests)
        known = requests.join(self.known, "key", "left")
        hits = known.where("content IS NOT NULL").select("id", "ns", "key", "content")
        made = requests.sparkSession.createDataFrame([], ANSWER)
        if self.completer is not None:
            fn = self.completer
            todo = known.where("content IS NULL").select(*REQUEST.replace(" string", "").replace(" double", "").replace(" int", "").split(", ")).dropDuplicates(["key"])

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                yield from fn.stream(batches) if isinstance(fn, Concurrent) else map(fn, batches)

            made = stable(todo.mapInPandas(run, ANSWER))
            new = made.where("error IS NULL AND content IS NOT NULL")
            self.replay = self.replay.select("key", "content", "error").union(new)
            self.known = self.known.union(new.select("key", "content"))  # none of these keys was known
        fresh = requests.join(made.where("error IS NULL AND content IS NOT NULL"), "key").select("id", "ns", "key", "content")
        out = stable(hits.union(fresh))
        log = requests.select("id", "ns", "key").join(out.select("id", "ns", F.lit(True).alias("ok")), ["id", "ns"], "left").join(hits.select("id", "ns", F.lit(True).alias("hit")), ["id", "ns"], "left")
        log = log.select("ns", "key", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("ok", F.lit(False)).alias("ok"))
        self.calls = log if self.calls is None else self.calls.union(log)
        return out.select("id", "ns", "content")


def no_replay(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ANSWER)


def canned(ns: str, key: str, user: str) -> str:
    """A deterministic stand-in for a model: what it says follows from the request's key, so that every filter sees
    both outcomes."""
    n = int(key[:8], 16)
    tail = user.rsplit("\n", 1)[-1]
    if ns.startswith("paraphrase_gen"):
        return json.dumps([f"Put otherwise: {tail}", f"In short: {tail}"]) if n % 5 else "no list"
    if ns.startswith("verify"):
        return ("ENTAILED", "ENTAILED", "ENTAILED", "CONTRADICTED", "NOT_ENOUGH_INFO")[n % 5]
    if ns.startswith("near_miss"):
        return json.dumps({"modified_question": f"Not: {tail}", "label": ("UNANSWERABLE", "CONTRADICTED")[n % 2]})
    if ns.startswith("equiv"):
        return json.dumps({"equivalent": n % 4 == 0})
    if ns.startswith("qa_gen"):
        w = user.split()
        made = [{"question": f"What follows {' '.join(w[-k - 6 : -k])}?", "answer": " ".join(w[-k:]), "evidence_span": " ".join(w[-20:]), "reason_type": " Lookup "} for k in (2, 3, 4)]
        return (json.dumps(made), json.dumps({"questions": made}), json.dumps(made[0]), "```json\n" + json.dumps({"items": made}) + "\n```", "no json", json.dumps([{"question": "", "answer": "x"}]))[n % 6]
    words = user.partition("\n\nQuestion:")[0].split()
    return " ".join(words[-3:]) if n % 3 else f"none {n % 7}"


def canned_completer(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"key": batch["key"], "content": [canned(*r) for r in zip(batch["ns"], batch["key"], batch["user"], strict=True)], "error": None})


#: The wording of every request, by stage; pass others to match answers that were recorded under them.
PROMPTS = {
    "brief": "Answer in a few words.",
    "evidence": "Answer from the evidence alone. If it holds no answer, say NOT_ANSWERABLE.",
    "json": "Answer with JSON and nothing else.",
    "label": "Answer with the label and nothing else.",
    "from_evidence": "Evidence:\n{evidence}\n\nQuestion:\n{question}",
    "generate": "Write {n} questions that only this text answers, as a JSON list of objects with question, answer, evidence_span and reason_type.\n\n{evidence}",
    "paraphrase": "Say the question in {k} other ways that mean the same, as a JSON list of strings.\n\nQuestion:\n{question}",
    "verify": "Does the evidence support the answer? One of ENTAILED, CONTRADICTED, NOT_ENOUGH_INFO.\n\nQuestion: {question}\nAnswer: {answer}\nEvidence: {evidence}",
    "near_miss": "Change one condition of the question so that the evidence no longer answers it or contradicts it, as JSON with modified_question and label (UNANSWERABLE or CONTRADICTED).\n\nQuestion:\n{question}",
    "equiv": "Do the two answers mean the same? JSON with equivalent.\n\nA: {a}\nB: {b}",
}


def filled(template: str, **columns: Column) -> Column:
    """A prompt template with columns in the place of its names."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def equivalent(client: Client, pairs: DataFrame, prompts: dict, use_model: bool = True) -> DataFrame:
    """(id, same) of pairs (id, a, b): by rule, and by a judge where the rule says no; a judge's failure says no."""
    ruled = stable(pairs.select("id", "a", "b", X.quick_equiv(F.col("a"), F.col("b")).alias("same")))
    if not use_model:
        return ruled.select("id", "same")
    rest = ruled.where("NOT same")
    said = client.answer(ask(rest, "id", F.lit("equiv"), prompts["json"], filled(prompts["equiv"], a=F.col("a"), b=F.col("b"))))
    judged = said.select("id", F.coalesce(F.try_variant_get(F.try_parse_json(loose_json(F.col("content"))), "$.equivalent", "boolean"), F.lit(False)).alias("judged"))
    return ruled.join(judged, "id", "left").select("id", (F.col("same") | F.coalesce("judged", F.lit(False))).alias("same"))


def build_pool(cands: DataFrame, client: Client, samples: int = SAMPLES, paraphrases: int = PARAPHRASES, tau: float = TAU, max_copy: float = MAX_COPY, strict_rate: float | None = None, use_model: bool = False, prompts: dict | None = None) -> DataFrame:
    """The checked pool of candidates (id, question, answer, span, single: the texts of each piece of evidence).

    (id, question, answer, ok, entropy, agreement, edge_score, copy, ctx_ok, verdict, strict_verdict, unknown).
    Stages: closed-book answer; where that is wrong, samples and paraphrases; edge score of at least tau; question
    not copied from its span; answered from the evidence; with two pieces of evidence, by neither alone; verified,
    and a share again strictly (None: none; 0 or less: all). A failed call drops the candidate."""
    prompts = PROMPTS | (prompts or {})
    brief, same = prompts["brief"], lambda pairs: equivalent(client, pairs, prompts, use_model)
    c = stable(cands.withColumn("question", F.trim("question")).withColumn("answer", F.trim("answer")).where("question <> '' AND answer <> ''"))

    said = client.answer(ask(c, "id", F.lit("closed_book"), brief, F.col("question")))
    cb = same(said.join(c, "id").select("id", F.col("content").alias("a"), F.col("answer").alias("b"))).withColumnRenamed("same", "ok")
    c = stable(c.join(cb, "id"))

    wrong = c.where("NOT ok").select("id", "question")
    drawn_ = wrong.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))) if samples > 0 else wrong.withColumn("i", F.lit(0)).limit(0)
    told = client.answer(ask(drawn_, "id", F.concat(F.lit("sample_"), F.col("i").cast("string")), brief, F.col("question"), 0.8))
    h = entropy(told.select("id", X.normalize_match(F.col("content")).alias("label")), "id", "label")

    gen = client.answer(ask(wrong, "id", F.lit("paraphrase_gen"), prompts["json"], filled(prompts["paraphrase"], k=F.lit(paraphrases), question=F.col("question")), 0.8, 192))
    listed = F.from_json(loose_json(F.col("content")), "array<string>")
    others = gen.select("id", F.posexplode(F.slice(F.filter(F.transform(listed, F.trim), lambda x: x != ""), 1, max(1, paraphrases))).alias("i", "q"))
    told = client.answer(ask(others, "id", F.concat(F.lit("paraphrase_answer_"), F.col("i").cast("string")), brief, F.col("q")))
    two = told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ns", "content"))), lambda x: x["content"]).alias("told")).where(F.size("told") >= 2)
    agree = same(two.select("id", F.get("told", F.lit(0)).alias("a"), F.get("told", F.lit(1)).alias("b"))).select("id", F.col("same").cast("double").alias("agreement"))

    c = c.join(h, "id", "left").join(agree, "id", "left").withColumns({"entropy": F.coalesce("entropy", F.lit(0.0)), "agreement": F.coalesce("agreement", F.lit(1.0))})
    c = c.withColumn("edge_score", edge_score(F.col("ok"), F.col("entropy"), F.col("agreement"))).where(F.col("edge_score") >= tau)
    c = stable(c.withColumn("copy", X.jaccard(X.word_set(F.col("question")), X.word_set(F.col("span")))).where((F.col("copy") <= max_copy) & (F.coalesce("span", F.lit("")) != "")))

    said = client.answer(ask(c, "id", F.lit("ctx_answer"), prompts["evidence"], filled(prompts["from_evidence"], evidence=F.col("span"), question=F.col("question"))))
    ctx = same(said.join(c, "id").select("id", F.col("content").alias("a"), F.col("answer").alias("b"))).withColumnRenamed("same", "ctx_ok")
    c = stable(c.join(ctx, "id").where("ctx_ok"))

    hops = c.where(multi_hop(F.col("single"))).select("id", "question", "answer", F.posexplode(F.slice("single", 1, 2)).alias("i", "evidence"))
    said = client.answer(ask(hops, "id", F.concat(F.lit("mh_single_ctx_"), F.col("i").cast("string")), prompts["evidence"], filled(prompts["from_evidence"], evidence=F.col("evidence"), question=F.col("question"))))
    alone = said.join(c.select("id", "answer"), "id").groupBy("id").agg(F.count("*").alias("n"), F.bool_or(X.quick_equiv(F.col("content"), F.col("answer"))).alias("enough"))
    bad = c.where(multi_hop(F.col("single"))).select("id").join(alone.where("n = 2 AND NOT enough"), "id", "left_anti")
    c = stable(c.join(bad, "id", "left_anti"))

    check = filled(prompts["verify"], question=F.col("question"), answer=F.col("answer"), evidence=F.col("span"))
    said = client.answer(ask(c, "id", F.lit("verify_fast"), prompts["label"], check))
    c = stable(c.join(said.select("id", X.verdict(F.col("content")).alias("verdict")), "id").where("verdict = 'ENTAILED'"))
    again = c.where(F.lit(strict_rate is not None) & (F.lit((strict_rate or 0) <= 0) | drawn(F.col("id"), strict_rate or 0, "strict")))
    said = client.answer(ask(again, "id", F.lit("verify_strict"), prompts["label"], check, 0.0, 128, "reasoner"))
    strict = again.select("id").join(said.select("id", X.verdict(F.col("content")).alias("strict_verdict")), "id", "left").select("id", F.coalesce("strict_verdict", F.lit("FAILED")).alias("strict_verdict"))
    c = c.join(strict, "id", "left").where("strict_verdict IS NULL OR strict_verdict = 'ENTAILED'")
    return c.select("id", "question", "answer", "ok", "entropy", "agreement", "edge_score", "copy", "ctx_ok", "verdict", "strict_verdict", (~F.col("ok") & F.col("ctx_ok")).alias("unknown"))


def build_stress(units: DataFrame, client: Client, paraphrases: int = PARAPHRASES, prompts: dict | None = None) -> DataFrame:
    """(id, type, canonical_id, question, answer, label): stress rows of units (id, question, answer, evidence).

    A unit whose question is verified gives its canonical row, up to `paraphrases` paraphrases, and a near-miss if
    the verifier bears out its label."""
    prompts = PROMPTS | (prompts or {})
    verify = lambda df: client.answer(ask(df, "id", F.lit("verify"), prompts["label"], filled(prompts["verify"], question=F.col("question"), answer=F.col("answer"), evidence=F.col("evidence")))).select("id", X.verdict(F.col("content")).alias("verdict"))
    u = stable(units.where("trim(question) <> '' AND trim(answer) <> ''"))
    u = stable(u.join(verify(u).where("verdict = 'ENTAILED'").select("id"), "id"))
    own = F.concat(F.col("id").cast("string"), F.lit(":"), F.substring(F.sha2(F.to_json(F.struct(F.col("answer").alias("a"), F.col("question").alias("q"), F.col("id").alias("unit_id"))), 256), 1, 16))
    u = stable(u.withColumn("canonical_id", own))
    canon = u.select(F.col("canonical_id").alias("row_id"), F.lit("canonical").alias("type"), "canonical_id", "question", "answer", F.lit("ANSWERABLE").alias("label"))

    gen = client.answer(ask(u, "id", F.lit("paraphrase_gen"), prompts["json"], filled(prompts["paraphrase"], k=F.lit(paraphrases), question=F.col("question")), 0.8, 192))
    listed = F.from_json(loose_json(F.col("content")), "array<string>")
    para = gen.select("id", F.posexplode(F.slice(F.filter(F.transform(listed, F.trim), lambda x: x != ""), 1, max(1, paraphrases))).alias("i", "q")).join(u.select("id", "canonical_id", "answer"), "id")
    para = para.select(F.concat("canonical_id", F.lit(":p"), F.col("i").cast("string"), F.lit(":"), F.substring(F.sha2("q", 256), 1, 16)).alias("row_id"), F.lit("paraphrase").alias("type"), "canonical_id", F.col("q").alias("question"), "answer", F.lit("ANSWERABLE").alias("label"))

    gen = client.answer(ask(u, "id", F.lit("near_miss_gen"), prompts["json"], filled(prompts["near_miss"], question=F.col("question")), 0.7, 256))
    o = F.try_parse_json(loose_json(F.col("content")))
    miss = gen.select("id", F.trim(F.try_variant_get(o, "$.modified_question", "string")).alias("question"), F.upper(F.trim(F.try_variant_get(o, "$.label", "string"))).alias("label")).where("question <> '' AND label IN ('UNANSWERABLE', 'CONTRADICTED')")
    miss = stable(miss.join(u.select("id", "canonical_id", "answer", "evidence"), "id"))
    miss = miss.join(verify(miss), "id").where(near_miss_accepted(F.col("label"), F.col("verdict")))
    miss = miss.select(F.concat("canonical_id", F.lit(":nm:"), F.substring(F.sha2("question", 256), 1, 16)).alias("row_id"), F.lit("near_miss").alias("type"), "canonical_id", "question", F.lit("").alias("answer"), "label")
    return canon.union(para).union(miss).withColumnRenamed("row_id", "id")


def judge_stress(rows: DataFrame, said: DataFrame) -> DataFrame:
    """(id, type, canonical_id, pred, abstain, confidence, correct) of stress rows and raw predictions (id, content).

    An answerable row is right if not abstained and equivalent; any other if abstained or blank. A row without a
    prediction abstains."""
    p = rows.join(said.select("id", "content"), "id", "left").withColumn("p", pred_contract(F.col("content")))
    right = F.when(F.col("label") == "ANSWERABLE", ~F.col("p.abstain") & X.quick_equiv(F.col("p.answer"), F.col("answer"))).otherwise(F.col("p.abstain") | (F.trim("p.answer") == ""))
    return p.select("id", "type", "canonical_id", F.col("p.answer").alias("pred"), F.col("p.abstain").alias("abstain"), F.col("p.confidence").alias("confidence"), right.alias("correct"))


def generate(sources: DataFrame, client: Client, per_source: int = 2, prompts: dict | None = None) -> DataFrame:
    """Candidates (id, question, answer, span, reason, single) that a model writes for sources (id, evidence: texts).

    An answer may be a list of objects, one object, or an object with a list under questions or items; what does not
    parse gives none, and no source gives more than `per_source`. Two pieces of evidence make a multi-hop question."""
    prompts = PROMPTS | (prompts or {})
    joined = F.array_join("evidence", "\n\n")
    ns = F.when(multi_hop(F.col("evidence")), "qa_gen_mh").otherwise("qa_gen")
    said = client.answer(ask(sources, "id", ns, prompts["json"], filled(prompts["generate"], n=F.lit(per_source), evidence=joined), 0.7, 256))
    one = "struct<question:string,answer:string,evidence_span:string,reason_type:string>"
    text = loose_json(F.col("content"))
    inner = F.coalesce(F.get_json_object(text, "$.questions"), F.get_json_object(text, "$.items"))
    listed = F.when(F.startswith(text, F.lit("[")), text).when(F.startswith(inner, F.lit("[")), inner).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    rows = said.select("id", F.posexplode(F.slice(F.from_json(listed, f"array<{one}>"), 1, per_source)).alias("i", "c")).where("c IS NOT NULL")
    made = rows.join(sources.select("id", "evidence"), "id").where("trim(c.question) <> '' AND trim(c.answer) <> ''")
    span = F.coalesce(F.nullif(F.trim("c.evidence_span"), F.lit("")), F.array_join("evidence", "\n\n"))
    hops = F.size("evidence")
    reason = F.when(hops >= 2, "multi-hop").otherwise(normalized_reason(F.col("c.reason_type")))
    return made.select(F.concat(F.col("id").cast("string"), F.lit("#"), F.col("i").cast("string")).alias("id"), F.trim("c.question").alias("question"), F.trim("c.answer").alias("answer"), span.alias("span"), reason.alias("reason"), F.col("evidence").alias("single"))


def cross_examine(items: DataFrame, client: Client, model: str, use_model: bool = False, prompts: dict | None = None) -> DataFrame:
    """(id, cb_ok, ctx_ok, unknown) of items (id, question, answer, span) by another model, without and with evidence.

    An item that the model did not answer is not right. Equivalence asks a judge only about what the rule refuses."""
    prompts = PROMPTS | (prompts or {})
    items = stable(items)
    flags = items.select("id")
    asked = (("cb_ok", F.lit("cross_cb"), prompts["brief"], F.col("question")), ("ctx_ok", F.lit("cross_ctx"), prompts["evidence"], filled(prompts["from_evidence"], evidence=F.col("span"), question=F.col("question"))))
    for name, ns, system, user in asked:
        said = client.answer(ask(items, "id", ns, system, user, 0.0, 64, model))
        ok = equivalent(client, said.join(items.select("id", "answer"), "id").select("id", F.col("content").alias("a"), F.col("answer").alias("b")), prompts, use_model)
        flags = flags.join(ok.withColumnRenamed("same", name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return flags.withColumn("unknown", ~F.col("cb_ok") & F.col("ctx_ok"))


def backfill(pool: DataFrame, client: Client, prompts: dict | None = None) -> DataFrame:
    """pool (id, question, answer, span, single, ok, entropy, agreement, edge_score) with the parts that were never
    worked out, worked out: only rows that need it are asked about, and rows that are still not answered stay."""
    todo = stable(pool.where(needs_backfill(F.col("edge_score"), F.col("entropy"), F.col("agreement"))))
    own = todo.select("id", "question", "answer", "span", "single")
    made = build_pool(own, client, tau=0.0, max_copy=1.0, prompts=prompts).select("id", *[F.col(c).alias(f"new_{c}") for c in ("entropy", "agreement", "edge_score")])
    out = pool.join(made, "id", "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("entropy", "agreement", "edge_score") else F.col(c) for c in pool.columns])


# fixed values: what a thinking budget leaves for the answer
ANSWER_TOKENS = 32


def thinking_budget(budget: int, max_tokens: int) -> int:
    """A thinking budget that leaves room for the answer: at most half of all tokens, and all but a few."""
    return max(0, min(budget, max_tokens - ANSWER_TOKENS, max_tokens // 2))


class Router:
    """Completers by the longest prefix of a request's model; a request that no prefix fits is an error row."""

    def __init__(self, routes: dict[str, Completer]):
        self.routes = sorted(routes.items(), key=lambda r: -len(r[0]))

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        of = batch["model"].map(lambda m: next((p for p, _ in self.routes if m.startswith(p)), None))
        parts = [fn(batch[of == p]) for p, fn in self.routes if (of == p).any()]
        lost = batch[of.isna()]
        if len(lost):
            parts.append(pd.DataFrame({"key": lost["key"], "content": None, "error": "no route"}))
        return pd.concat(parts, ignore_index=True)


def run_job(state: dict, submit: Callable[[], str], poll: Callable[[str], str], save: Callable[[dict], None], wait: Callable[[], None], most: int = 1000) -> str:
    """A batch job's end state. Its id is saved before it is waited for, so a driver that comes back waits on."""
    if "job" not in state:
        state["job"] = submit()
        save(state)
    for _ in range(most):
        state["status"] = poll(state["job"])
        save(state)
        if state["status"] in ("completed", "failed", "cancelled", "expired"):
            return state["status"]
        wait()
    return "pending"


def benchmark_candidates(spark, d) -> DataFrame:
    """Candidates from the benchmark's items: their first words ask, their last three answer, the item is the evidence."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", w.alias("w"))
    single = F.when(F.col("id") % 3 == 0, F.array(F.concat_ws(" ", F.slice("w", 1, 8)), F.col("text"))).otherwise(F.array("text"))
    return b.select("id", F.concat(F.lit("What follows "), F.concat_ws(" ", F.slice("w", 1, 6)), F.lit(" ... "), F.element_at("w", -1), F.lit("?")).alias("question"), F.concat_ws(" ", F.slice("w", -3, 3)).alias("answer"), F.col("text").alias("span"), single.alias("single"))


@query("edge_pool")
def _pool(spark, d):
    """The staged pool over the benchmark, answered by the canned completer; a test replays it row by row."""
    out = build_pool(benchmark_candidates(spark, d), Client(no_replay(spark), canned_completer), strict_rate=0.5)
    return out.select("id", "ok", F.round("entropy", 6).alias("entropy"), "agreement", F.round("edge_score", 6).alias("edge_score"), F.round("copy", 6).alias("copy"), "verdict", "strict_verdict", "unknown")


@query("stress_rows")
def _stress(spark, d):
    units = benchmark_candidates(spark, d).select("id", "question", "answer", F.col("span").alias("evidence"))
    return build_stress(units, Client(no_replay(spark), canned_completer)).select("id", "type", "canonical_id", "label")


@query("stress_eval")
def _stress_eval(spark, d):
    client = Client(no_replay(spark), canned_completer)
    rows = stable(build_stress(benchmark_candidates(spark, d).select("id", "question", "answer", F.col("span").alias("evidence")), client))
    said = client.answer(ask(rows, "id", F.lit("pred"), PROMPTS["json"], F.col("question")))
    return judge_stress(rows, said)


@query("call_log")
def _call_log(spark, d):
    """What a staged run asks, by namespace, and what a second run over the recorded answers asks again: nothing."""
    first = Client(no_replay(spark), canned_completer)
    build_pool(benchmark_candidates(spark, d), first).count()
    again = Client(first.replay, canned_completer)
    build_pool(benchmark_candidates(spark, d), again).count()
    count = lambda log, run: log.groupBy("ns").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hit"), F.count_if("ok").alias("n_ok")).withColumn("run", F.lit(run))
    return count(first.calls, 1).union(count(again.calls, 2))


def key_of(ns: str, system: str, user: str, temperature: float = 0.0, max_tokens: int = 64, model: str = MODEL) -> str:
    """request_key of one request, outside Spark."""
    req = {"max_tokens": max_tokens, "messages": [{"content": system, "role": "system"}, {"content": user, "role": "user"}], "model": model, "temperature": temperature}
    return hashlib.sha256(json.dumps({"ns": ns, "req": req}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@query("qa_generate")
def _generate(spark, d):
    """Questions written for every item of the benchmark, two texts together for a third of them."""
    b = table(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("more"))
    sources = b.join(other, "item_id", "left").select(F.col("item_id").alias("id"), F.when((F.col("item_id") % 3 == 0) & F.col("more").isNotNull(), F.array("text", "more")).otherwise(F.array("text")).alias("evidence"))
    return generate(sources, Client(no_replay(spark), canned_completer)).select("id", "question", "answer", "reason", F.size("single").alias("hops"))


@query("cross_eval")
def _cross(spark, d):
    return cross_examine(benchmark_candidates(spark, d), Client(no_replay(spark), canned_completer), "other")
