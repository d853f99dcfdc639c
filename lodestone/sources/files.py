"""Files as tables and back: JSON lines, JSON, TSV, CSV, retrieval collections, batch outputs, manifests, key-value tables.

Readers take a schema, so that a missing key, a null and an absent file column all come out as null. Writers go
through Spark's committers: a lost or repeated task leaves no half-written row.
"""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.catalog import query
from lodestone.plans.joins import scratch
from lodestone.plans.tables import table

# ---- readers ------------------------------------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a row that does not parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; torn rows and rows that are no objects are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    names = [c for c in rows.columns if c != "_corrupt_record"]
    return rows.where("_corrupt_record IS NULL").select(*names)


def read_json(path: str):
    """One JSON document, on the driver; None if there is no such file or it is no object."""
    try:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
    except (OSError, ValueError):
        return None
    return made if isinstance(made, dict) else None


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id) of a TSV file: a heading that starts with query-id goes, rows of one field too, repeats count once."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("qid string, doc_id string, score string").csv(path)
    return rows.where(~F.startswith(F.lower("qid"), F.lit("query-id")) & F.col("doc_id").isNotNull()).select("qid", "doc_id").distinct()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a heading; fields may hold line ends and doubled quotes. All columns are strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a retrieval collection under path."""
    corpus = read_jsonl(spark, f"{path}/corpus.jsonl", "_id string, title string, text string")
    return corpus, read_jsonl(spark, f"{path}/queries.jsonl", "_id string, text string"), read_qrels(spark, f"{path}/qrels.tsv")


def read_batch_output(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, body, error) of a batch job's output lines: a body as JSON text only if the call succeeded."""
    rows = read_jsonl_tolerant(spark, path, "custom_id string, response struct<status_code:int, body:string>, error string")
    ok = F.col("response.status_code") == 200
    return rows.where("custom_id IS NOT NULL").select("custom_id", F.when(ok, F.col("response.body")).alias("body"), F.coalesce("error", F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(F.col("response.status_code").cast("string"), F.lit("none"))))).alias("error"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached embeddings (id, embedding) under path; None if nothing was cached."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema("id long, embedding array<float>").parquet(path) if there else None


def cached_embeddings(spark: SparkSession, path: str, texts: DataFrame, encode) -> DataFrame:
    """(id, embedding) of texts (id, text): those cached under path, and the others by `encode`, a function from a
    DataFrame to (id, embedding), which are added to the cache."""
    had = read_embeddings(spark, path)
    todo = texts if had is None else texts.join(had.select("id"), "id", "left_anti")
    encode(todo).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)
    return read_embeddings(spark, path).join(texts.select("id"), "id", "left_semi")


def merged(base: dict, over: dict) -> dict:
    """A configuration over its defaults: mappings merge at every depth, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_config(path: str, defaults: dict, folders: tuple[str, ...] = ("artifacts_dir", "cache_dir")) -> dict:
    """Defaults with the JSON or YAML file's values over them; the named folders are taken relative to the file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        own = json.loads(text)
    except ValueError:
        import yaml  # only where a file is YAML

        own = yaml.safe_load(text) or {}
    out = merged(defaults, own)
    for k in folders:
        if k in out:
            out[k] = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), out[k]))
    return out


def checked_out(path: str, version: str | None = None) -> tuple[str, str]:
    """(path, version) of a source tree that is there already; the version is read from its .git if not given."""
    if version is None:
        git = os.path.join(path, ".git")
        with open(os.path.join(git, "HEAD"), encoding="utf-8") as f:
            version = f.read().strip()
        if version.startswith("ref: "):
            name, loose = version[5:], os.path.join(git, version[5:])
            if os.path.exists(loose):
                with open(loose, encoding="utf-8") as f:
                    version = f.read().strip()
            else:
                with open(os.path.join(git, "packed-refs"), encoding="utf-8") as f:
                    version = next(line.split()[0] for line in f if line.strip().endswith(" " + name))
    return path, version


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


# ---- writers ------------------------------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report of a few rows as one pretty JSON document, on the driver, in the place of an older one at once."""
    made = [r.asDict(recursive=True) for r in rows.collect()]
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(made[0] if len(made) == 1 else made, f, ensure_ascii=False, indent=2)
    os.replace(path + ".tmp", path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with these columns in this order: others are left out, missing ones and nulls are empty."""
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*have).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_collection(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> str:
    """A retrieval collection: corpus (_id, title, text), queries (_id, text), qrels (qid, doc_id), each pair scored 1."""
    write_jsonl(corpus.select("_id", F.coalesce("title", F.lit("")).alias("title"), "text"), f"{path}/corpus.jsonl")
    write_jsonl(queries.select("_id", "text"), f"{path}/queries.jsonl")
    rows = qrels.select(F.col("qid").cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.lit(1).alias("score"))
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).csv(f"{path}/qrels.tsv")
    return path


def prefix(df: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """The first n of a ranked table; a prefix is a filter, never a file of its own."""
    return df.where(F.col(rank) <= n)


def kv_put(rows: DataFrame, path: str) -> None:
    """Add (key, value) to a key-value table: one commit for all rows, after which readers see them all."""
    rows.select("key", "value", F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(path)


def kv_get(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, value) of the keys that are there; the last put of a key counts."""
    held = spark.read.schema("key string, value string, at long").parquet(path).join(keys.select("key").distinct(), "key", "left_semi")
    return held.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version of a table beside its older ones, which stay as backups, and return the version's path.

    A version is a folder named by its number; current_version() finds the last one that was committed."""
    spark = df.sparkSession
    number = (int(now.rsplit("/v", 1)[1]) if (now := current_version(spark, path)) else 0) + 1
    df.write.parquet(f"{path}/v{number:06d}")
    return f"{path}/v{number:06d}"


def current_version(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [n for n in sorted(names) if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return f"{path}/{done[-1]}" if done else None


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file under path but manifests and checksum lists, paths relative to it.

    A file is read whole by one task, which Spark allows up to 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    base = path.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    inside = F.substring_index(F.col("path"), base, -1)
    return files.where(~name.isin("MANIFEST.json", "SHA256SUMS.txt") & ~F.startswith(name, F.lit("_"))).select(inside.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_lines(files: DataFrame) -> Column:
    return F.concat("sha256", F.lit("  "), "path")


# ---- round trips as queries -----------------------------------------------------------------------------------------


@query("jsonl_round_trip", "SELECT doc_id, lang, md5(text) AS h FROM documents")
def _jsonl(spark, d):
    path = scratch(spark, "jsonl")
    write_jsonl(table(spark, d, "documents").where("doc_id % 2 = 0"), path)
    write_jsonl(table(spark, d, "documents").where("doc_id % 2 = 1"), path, append=True)
    return read_jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("h"))


@query("jsonl_tolerant", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 5 NOT IN (0, 1, 2)")
def _tolerant(spark, d):
    """Lines of a log: some torn, some blank, some no objects."""
    whole = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    line = F.when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 12)).when(F.col("event_id") % 5 == 1, "").when(F.col("event_id") % 5 == 2, "[1]").otherwise(whole)
    path = scratch(spark, "log")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return read_jsonl_tolerant(spark, path, "event_id long, k long").where("event_id IS NOT NULL")


@query("qrels_round_trip", "SELECT DISTINCT o_custkey::VARCHAR AS qid, l_partkey::VARCHAR AS doc_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 3")
def _qrels(spark, d):
    pairs = table(spark, d, "orders").where("o_custkey % 10 = 3").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query-id"), F.col("l_partkey").alias("corpus-id"), F.lit(1).alias("score"))
    path = scratch(spark, "qrels")
    pairs.write.option("sep", "\t").option("header", True).csv(path)
    return read_qrels(spark, path)


@query("csv_round_trip", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, md5(text || ' \"quoted\", ' || chr(10) || role) AS h, '' AS fill FROM conversations")
def _csv(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.concat("text", F.lit(' "quoted", \n'), "role"))
    path = scratch(spark, "csv")
    write_csv(rows, path, ["conv_id", "turn", "text", "fill"])
    return read_csv(spark, path).select("conv_id", "turn", F.md5("text").alias("h"), F.coalesce("fill", F.lit("")).alias("fill"))


@query("beir_round_trip", "SELECT 'corpus' AS kind, count(*) AS n, sum(length(text))::BIGINT AS size FROM documents UNION ALL SELECT 'queries', count(*), sum(length(text))::BIGINT FROM benchmark UNION ALL SELECT 'qrels', count(*), sum(item_id)::BIGINT FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def _beir(spark, d):
    from lodestone.operators.retrieval_queries import _items, verbatim

    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    corpus = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text")
    path = write_collection(corpus, items.select(F.col("item_id").cast("string").alias("_id"), "text"), verbatim(docs.select("doc_id", "text"), _items(spark, d)), scratch(spark, "beir"))
    c, q, r = read_collection(spark, path)
    size = lambda df, kind, s: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(s).cast("long").alias("size"))
    return size(c, "corpus", F.length("text")).union(size(q, "queries", F.length("text"))).union(size(r, "qrels", F.col("qid").cast("long")))


@query("batch_output", "SELECT 'r' || event_id AS custom_id, CASE WHEN event_id % 3 = 0 THEN props END AS body, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP 429' ELSE 'timeout' END AS error FROM events")
def _batch(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("custom_id"), F.when(F.col("event_id") % 3 < 2, F.struct(F.when(F.col("event_id") % 3 == 0, 200).otherwise(429).alias("status_code"), F.col("props").alias("body"))).alias("response"), F.when(F.col("event_id") % 3 == 2, "timeout").alias("error"))
    path = scratch(spark, "batch")
    write_jsonl(e, path)
    return read_batch_output(spark, path)


@query("embedding_cache", "SELECT vec_id AS id, len(embedding)::INTEGER AS dims, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def _embedding_cache(spark, d):
    """Half of the vectors are cached first; then all are asked for, and only the other half is encoded."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path, encode = scratch(spark, "vectors"), lambda todo: todo.select("id").join(v, "id")
    cached_embeddings(spark, path, v.where("id % 2 = 0").select("id"), encode)
    got = cached_embeddings(spark, path, v.select("id"), encode)
    return got.select("id", F.size("embedding").alias("dims"), (F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6) + F.lit(0.0)).alias("total"))


@query("kv_round_trip", "SELECT user_id::VARCHAR AS key, max(event_id)::VARCHAR AS value FROM events WHERE user_id % 3 = 0 GROUP BY user_id")
def _kv(spark, d):
    e, path = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")), scratch(spark, "kv")
    kv_put(e.agg(F.min("event_id").cast("string").alias("value")), path)
    kv_put(e.agg(F.max("event_id").cast("string").alias("value")), path)
    return kv_get(spark, path, table(spark, d, "events").where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("key")))


@query("first_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def _first(spark, d):
    return first_rows(table(spark, d, "documents"), ["doc_id"], 25).select("doc_id", "source")


@query("release_manifest")
def _manifest(spark, d):
    """The manifest of a package written a moment ago; file names are the writer's, so a test holds the hashes."""
    path = scratch(spark, "release")
    write_jsonl(table(spark, d, "nation"), f"{path}/nation")
    write_jsonl(table(spark, d, "region"), f"{path}/region")
    return manifest(spark, path)


@query("html_extract", r"SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS n_paragraphs, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS n_links FROM pages")
def _html(spark, d):
    p = table(spark, d, "pages")
    count = lambda pattern: F.coalesce(F.regexp_count("html", F.lit(pattern)), F.lit(0)).cast("long")
    return p.select("page_id", F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), count("<p[ >]").alias("n_paragraphs"), count("<a [^>]*href=").alias("n_links"))


@query("course_passages")
def _course(spark, d):
    """Documents as course files, two units each, through the LaTeX parser."""
    from lodestone.sources.courses import latex_course

    docs = table(spark, d, "documents").where("text IS NOT NULL")
    files = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), F.concat(F.lit("\\begin{thm}\n"), "text", F.lit("\n\\begin{proof}\nShort \\emph{proof} here.\n\\end{proof}\n\\end{thm}\n")).alias("text"))
    passages, units = latex_course(files)
    return passages.select("passage_id", "doc_id", "unit_id", F.length("text").cast("long").alias("n_chars")).withColumn("kind", F.lit("passage")).unionByName(units.select(F.lit(None).cast("string").alias("passage_id"), "doc_id", "unit_id", F.length("text").cast("long").alias("n_chars"), F.lit("unit").alias("kind")))


def chunked_ids(ids: DataFrame, id_: str, size: int) -> DataFrame:
    """ids with `chunk`: their place in ascending order over `size`, for batches of bounded size."""
    from lodestone.plans.joins import running_sum

    ranked = running_sum(ids.select(id_).distinct(), [id_], F.lit(1), "__place")
    return ranked.select(id_, F.floor((F.col("__place") - 1) / size).cast("long").alias("chunk"))


@query("batch_chunks", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents ANTI JOIN labels USING (doc_id)")
def _chunks(spark, d):
    pending = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return chunked_ids(pending, "doc_id", 64)


def pending(sources: DataFrame, key: str, done: DataFrame, output: DataFrame, repair: bool = False) -> DataFrame:
    """Sources that are still to do. The done table says which are not; if it is empty, the output does. A repair
    trusts the output alone, so that sources marked done without output run again."""
    if repair or done.isEmpty():
        return sources.join(output.select(key).distinct(), key, "left_anti")
    return sources.join(done.select(key).distinct(), key, "left_anti")


@query("resume_sources", "SELECT 'done' AS mode, doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) l USING (doc_id) UNION ALL SELECT 'inferred', doc_id FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'repair', doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def _resume(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    done, kept = labels.where("doc_id % 2 = 0").select("doc_id"), labels.where("quality = 1").select("doc_id")
    modes = {"done": pending(docs, "doc_id", done, labels), "inferred": pending(docs, "doc_id", done.limit(0), labels), "repair": pending(docs, "doc_id", done, kept, repair=True)}
    parts = [df.select(F.lit(name).alias("mode"), "doc_id") for name, df in modes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("write_back", "SELECT doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'again' END, d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def _write_back(spark, d):
    """New values for some rows over the old ones, as a new version of the table; the old version stays."""
    path = scratch(spark, "versions")
    replace_table(table(spark, d, "documents").select("doc_id", "lang"), path)
    old = spark.read.parquet(current_version(spark, path))
    new = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("again").alias("made"))
    replace_table(old.join(new, "doc_id", "left").select("doc_id", F.coalesce("made", "lang").alias("lang")), path)
    return spark.read.parquet(current_version(spark, path))


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an order: how a table with repeated keys reads as a mapping."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")
