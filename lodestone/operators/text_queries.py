"""Text operators: normalisation, splitting, tokenising, exact de-duplication."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.plans.catalog import query
from lodestone.plans.joins import spread_join, stable
from lodestone.plans.tables import table
from lodestone.sources.courses import latex_text

# SQL forms of the expressions in functions.text
WS = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
MATCH = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g'))"


def dedup_first(df: DataFrame, text: str, ord_: str) -> DataFrame:
    """The first row, by ordinal, of each text: one grouped minimum, combined before the shuffle."""
    first = df.groupBy(F.sha2(X.normalize_ws(F.col(text)), 256).alias("text_hash")).agg(F.min(F.struct(ord_, *[c for c in df.columns if c != ord_])).alias("r"))
    return first.select("r.*", "text_hash")


@query("normalize_ws", f"SELECT doc_id, {WS.format('text')} AS norm FROM documents")
def _normalize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_ws(F.col("text")).alias("norm"))


@query("normalize_match", f"SELECT doc_id, {MATCH.format('text')} AS norm FROM documents")
def _normalize_match(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_match(F.col("text")).alias("norm"))


@query("sentence_split", rf"""SELECT doc_id, len(s)::BIGINT AS n_sentences, s[1] AS first_sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace({WS.format('text')}, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)""")
def _sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@query("paragraph_split", r"""SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, '') || chr(10) || ' ' || chr(10) || role, '\n[ \t]*\n'), lambda b: trim(regexp_replace(b, '\s*\n\s*', ' ', 'g'))), lambda b: b <> '')) AS paragraph FROM conversations""")
def _paragraphs(spark, d):
    joined = F.concat(F.coalesce("text", F.lit("")), F.lit("\n \n"), F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(X.paragraphs(joined)).alias("paragraph"))


@query("tok_mining", "SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS token FROM documents")
def _tok_mining(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.tokens_mining(F.col("text"))).alias("token"))


@query("tok_bm25", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS dl FROM documents")
def _tok_bm25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens_alnum(F.col("text"))).cast("long").alias("dl"))


@query("tok_set", f"SELECT doc_id, len(list_distinct(regexp_extract_all({MATCH.format('text')}, '[a-z0-9]+')))::BIGINT AS n_tokens, len(list_distinct(list_filter(string_split({MATCH.format('text')}, ' '), lambda w: w <> '')))::BIGINT AS n_words FROM documents")
def _tok_set(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(X.token_set(t)).cast("long").alias("n_tokens"), F.size(X.word_set(t)).cast("long").alias("n_words"))


@query("term_frequency", "SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS token FROM documents) GROUP BY token")
def _term_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(X.tokens_mining(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("content_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def _content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("dedup_exact", f"SELECT doc_id, source, lang, h AS text_hash FROM (SELECT *, sha256({WS.format('text')}) AS h FROM documents) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1")
def _dedup(spark, d):
    return dedup_first(table(spark, d, "documents").select("doc_id", "text", "source", "lang"), "text", "doc_id").drop("text")


@query("quick_equiv_pairs", rf"""
WITH p AS (SELECT a.item_id AS a, b.item_id AS b, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1
  UNION ALL SELECT -1, n_nationkey, n_name, n_name || '.' FROM nation UNION ALL SELECT -2, c_custkey, c_name, c_custkey::VARCHAR FROM customer),
n AS (SELECT a, b, {MATCH.format('x')} AS x, {MATCH.format('y')} AS y FROM p),
s AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM n)
SELECT a, b, x <> '' AND y <> '' AND (x = y OR ((len(string_split(s, ' ')) >= 2 OR length(s) >= 8) AND contains(l, s))
  OR coalesce(abs(try_cast(nullif(regexp_extract(x, '[0-9]+'), '') AS DOUBLE) - try_cast(nullif(regexp_extract(y, '[0-9]+'), '') AS DOUBLE)) < 1e-9, false)) AS equivalent FROM s""")
def _quick_equiv(spark, d):
    b = table(spark, d, "benchmark")
    pairs = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    n = table(spark, d, "nation").select(F.lit(-1).cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"), F.col("n_name").alias("x"), F.concat("n_name", F.lit(".")).alias("y"))
    c = table(spark, d, "customer").select(F.lit(-2).cast("long").alias("a"), F.col("c_custkey").cast("long").alias("b"), F.col("c_name").alias("x"), F.col("c_custkey").cast("string").alias("y"))
    return pairs.union(n).union(c).select("a", "b", X.quick_equiv(F.col("x"), F.col("y")).alias("equivalent"))


@query("verdict_parse", rf"""
SELECT event_id, CASE WHEN contains(n, 'entailed') THEN 'ENTAILED' WHEN contains(n, 'contradicted') THEN 'CONTRADICTED' WHEN contains(n, 'not enough info') OR contains(n, 'insufficient') THEN 'NOT_ENOUGH_INFO' WHEN n <> '' THEN upper(string_split(n, ' ')[1]) ELSE 'UNKNOWN' END AS verdict
FROM (SELECT event_id, {MATCH.format("(['NOT ENTAILED','Contradicted!','NOT_ENOUGH_INFO','insufficient evidence','Maybe so',''])[event_id % 6 + 1]")} AS n FROM events)""")
def _verdict(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("NOT ENTAILED", "Contradicted!", "NOT_ENOUGH_INFO", "insufficient evidence", "Maybe so", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.verdict(said).alias("verdict"))


@query("tristate_parse", """SELECT event_id, CASE WHEN lower(trim(v)) IN ('true','yes','y','1') THEN true WHEN lower(trim(v)) IN ('false','no','n','0') THEN false END AS flag FROM (SELECT event_id, (['Yes',' no ','partial','1','0','unclear'])[event_id % 6 + 1] AS v FROM events)""")
def _tristate(spark, d):
    v = F.element_at(F.array(*map(F.lit, ("Yes", " no ", "partial", "1", "0", "unclear"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.tristate(v).alias("flag"))


@query("truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS short FROM documents")
def _truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text"), 80).alias("short"))


# fixed values: phrases that speak of a definition or a result, each counted once a passage
CUES = ("definition", "theorem", "lemma", "corollary", "proof", "we define", "is defined", "means that", "if and only if")

SALIENCE = r"""
WITH tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS token FROM documents),
tf AS (SELECT token, count(*) AS f FROM tok GROUP BY token),
r AS (SELECT doc_id, sum(1 / sqrt(f)) / count(*) AS rarity FROM tok JOIN tf USING (token) GROUP BY doc_id),
s AS (SELECT doc_id, source, coalesce(rarity, 0) AS rarity, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{2,}'))) AS caps, len(regexp_extract_all(text, '[0-9]')) AS nums, {cues} AS cues FROM documents LEFT JOIN r USING (doc_id))
""".replace("{cues}", " + ".join(f"contains({MATCH.format('text')}, '{c}')::INT" for c in CUES))
SCORE = "1.5::DOUBLE * cues + rarity + 0.05::DOUBLE * caps + 0.02::DOUBLE * nums"


def salience(docs: DataFrame) -> DataFrame:
    """(doc_id, source, rarity, score): mean inverse-root frequency of a document's tokens, plus cue phrases,
    capitals and digits. A null text has none of them.

    Counting is two-level (a token's count in a document, then its sum), so what is shuffled and joined is
    distinct tokens of documents, not every occurrence; common tokens are dealt over tasks in the join."""
    per = stable(docs.select("doc_id", F.explode(X.tokens_mining(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf")))
    corpus = per.groupBy("token").agg(F.sum("tf").alias("f"), F.count("*").alias("n"))
    rarity = spread_join(per, corpus, ["token"], per.count(), by="doc_id").groupBy("doc_id").agg((F.sum(F.col("tf") / F.sqrt("f")) / F.sum("tf")).alias("rarity"))
    caps, nums = F.regexp_count("text", F.lit(r"(?U)\b[A-Z][a-z]{2,}\b")), F.regexp_count("text", F.lit("[0-9]"))
    plain = docs.select("doc_id", "source", "text", X.normalize_match(F.col("text")).alias("plain"))
    cues = sum((F.contains("plain", F.lit(c)).cast("int") for c in CUES[1:]), F.contains("plain", F.lit(CUES[0])).cast("int"))
    marks = plain.select("doc_id", "source", F.coalesce(cues * 1.5 + caps * 0.05 + nums * 0.02, F.lit(0.0)).alias("marks"))
    rare = F.coalesce("rarity", F.lit(0.0))
    return marks.join(rarity, "doc_id", "left").select("doc_id", "source", rare.alias("rarity"), (F.col("marks") + rare).alias("score"))


@query("mine_rarity", SALIENCE + "SELECT doc_id, round(rarity, 6) AS rarity FROM s")
def _rarity(spark, d):
    return salience(table(spark, d, "documents")).select("doc_id", F.round("rarity", 6).alias("rarity"))


@query("mine_score", SALIENCE + f"SELECT doc_id, round({SCORE}, 6) AS score FROM s")
def _score(spark, d):
    return salience(table(spark, d, "documents")).select("doc_id", F.round("score", 6).alias("score"))


@query("mine_top_k", SALIENCE + f"SELECT doc_id, source, round({SCORE}, 6) AS score FROM s ORDER BY round({SCORE}, 9) DESC, doc_id LIMIT 100")
def mine_top_k(spark, d):
    best = salience(table(spark, d, "documents")).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(100)
    return best.select("doc_id", "source", F.round("score", 6).alias("score"))


# a comment ends where Python's splitlines ends a line
COMMENT = r"(?<!\\)%[^\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]*"


@query("latex_plain")
def _latex_plain(spark, d):
    """Whole texts without LaTeX; SQL has no loop to a fixpoint, so a brute-force test stands for a twin."""
    return table(spark, d, "documents").select("doc_id", latex_text(F.regexp_replace("text", COMMENT, "")).alias("plain"))


@query("unit_counter", "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations")
def _unit_counter(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.count("*").over(w).alias("n"))
