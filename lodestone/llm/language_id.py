"""Language identification by multilingual mixture inference.

Every language has a distribution over hashed byte trigrams. A document is a mixture of languages;
expectation-maximisation estimates its proportions from the trigram likelihoods. The language set is
selected by penalised likelihood: languages join in the order of their proportions as long as the gain in
log-likelihood exceeds the penalty for one more. The prediction is the language with the largest
proportion in the selected set, and that proportion is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, utf8

GRAMS = 1 << 15  # hashed trigrams
PER_LANGUAGE = 3000  # labelled documents that a language's distribution is fitted on, about
ROUNDS = 12  # of expectation-maximisation
PENALTY = 6.0  # log-likelihood units, times the logarithm of a document's trigrams, for another language
SMOOTH = 0.5

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def gram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of a text's letters and the spaces around its words."""
    x = np.frombuffer(b" " + (text or b"").translate(_TABLE) + b" ", np.uint8).astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    code = code[(code & 0xFFFF) != 0x2020]
    n = np.bincount((code * np.uint32(2654435761)) >> np.uint32(17), minlength=GRAMS)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float64)


def learned(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods [language, gram]) from rows (key, text, lang).

    Fitted on a sample bounded by `per_language` documents a language (about: by a hash of the key), of
    which whole texts count. Every language is learned: 128 KB of model each, and no bound on their number. Null
    langs are not learned from; a null text adds nothing; an empty table makes a model without languages. Rows that
    repeat count as often as the sample has them. Other columns are not read."""
    labelled = labelled.select("key", "text", "lang").where("lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(per_language) / F.col("n")).alias("rate"))
    picked = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    sample = labelled.join(F.broadcast(sizes), F.col("lang") == F.col("l")).where(picked).select("lang", "text")  # a row a language, as the model has

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), utf8(b), strict=True):
                at, n = gram_counts(text)
                total.setdefault(lang, np.zeros(GRAMS, np.float32))[at] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array([v.tobytes() for v in total.values()], pa.binary())], schema=_to_arrow("lang string, counts binary"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "counts": [sum(np.frombuffer(x, np.float32) for x in pdf["counts"]).tobytes()]})

    rows = sample.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary").collect()  # a row a language
    names = sorted(r["lang"] for r in rows)
    found = {r["lang"]: np.frombuffer(r["counts"], np.float32) + np.float32(SMOOTH) for r in rows}
    return names, np.stack([np.log(found[k] / found[k].sum(dtype=np.float64)) for k in names]).astype(np.float32) if names else np.zeros((0, GRAMS), np.float32)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of languages whose gram probabilities are p [language, gram], by EM."""
    w = np.full(len(p), 1 / len(p))
    for _ in range(rounds if len(p) > 1 else 0):
        mixed = w @ p
        w = w * (p @ (n / mixed))
        w /= w.sum()
    return w, float(n @ np.log(w @ p))


def infer(likelihoods: np.ndarray, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(selected languages, their proportions), the largest proportion first; ties to the first language."""
    at, n = gram_counts(text)
    if not len(at):
        return np.zeros(0, int), np.zeros(0)
    logs = likelihoods[:, at].astype(np.float64)
    p = np.exp(logs)
    share, _ = mixture(p, n)
    order = np.argsort(-share, kind="stable")
    alone = logs @ n
    single = alone.argmax()
    order = np.r_[single, order[order != single]]
    chosen, w, best = order[:1], np.ones(1), float(alone[single])
    for k in order[1:]:
        more = np.r_[chosen, k]
        w_more, gain = mixture(p[more], n)
        if gain - best <= PENALTY * np.log(n.sum() + 1):
            break
        chosen, w, best = more, w_more, gain
    by = np.argsort(-w, kind="stable")
    return chosen[by], w[by]


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score[, mixture as text]) of every row of docs.

    `und` with score 0 if the text is null or has no letter, or nothing was learned. Of languages that tie, the
    first by name is predicted. A very long text is read whole. Only doc_id and text are read, whatever other
    columns are called. Repeated rows get equal predictions; a null doc_id stays null; an empty table gives no rows."""
    names, likelihoods = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow("doc_id long, lang_pred string, score double, mixture string")
        for b in batches:
            rows = []
            for letter, text in zip(b.column("letter").to_pylist(), utf8(b), strict=True):
                chosen, w = infer(likelihoods, text) if letter and names else ((), ())
                rows.append((names[chosen[0]], float(min(1.0, w[0])), " ".join(f"{names[k]}:{x:.3f}" for k, x in zip(chosen, w, strict=True))) if len(chosen) else ("und", 0.0, ""))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[1:], strict=True))], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = learned(train.select(F.col("doc_id").alias("key"), "text", "lang"))
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
