"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character bigrams and trigrams of the lower-cased text fall into BUCKETS hashed buckets. The smoothed log-probabilities of
each language are one buckets x languages matrix, which is broadcast (its size is fixed by BUCKETS and MAX_LANGS); texts
are scored in numpy, PIECE_CHARS characters of a batch at a time. The model is fitted on at most TRAIN_DOCS labelled documents, those with the smallest id
hashes among the documents of the training folds. Only text and lang of training documents are learnt from, and only text is an input of a prediction.

Null text, empty text and text without a letter: lang_pred `und`, score 0. With no training documents, everything is
`und`. Very long texts are read whole. Equal texts get equal predictions; ties go to the language
that sorts first. Rows with a null doc_id are predicted, and never learnt from. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelark.llm.common import BATCH_ROWS, annotate
from treelark.llm.resampling import pieces

BUCKETS = 1 << 15
TRAIN_DOCS, MAX_LANGS = 20_000, 1_000
ALPHA = 0.5
#: Characters of texts whose n-grams are held as arrays at a time, some 60 bytes each; a longer text is held alone.
PIECE_CHARS = 1 << 20
FOLDS, HELD_OUT = 4, 2
VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character bigrams and trigrams, and the text of each."""
    low = [t.lower() if t else "" for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    mixed = points * np.uint32(0x9E3779B1)
    two = (mixed[:-1] * np.uint32(0x85EBCA6B)) ^ mixed[1:]
    three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ mixed[2:]
    found, own = [], []
    for h, n in ((two, 1), (three, 2)):
        ok = doc[n:] == doc[: len(doc) - n]
        found.append(((h * np.uint32(0x27D4EB2F)) >> shift)[ok])
        own.append(doc[n:][ok])
    return np.concatenate(found).astype(np.int64), np.concatenate(own)


def held_out(ident: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, lang) of at most `limit` labelled documents outside the held-out fold."""
    ok = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return ok.select("doc_id", "lang").orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id", "lang").limit(limit)


def fit(docs: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages, and log-probabilities by bucket and language with the log-prior as the last row."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sample = training_sample(docs, limit).select("doc_id", F.col("lang").alias("train_lang")).distinct()
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.where("lang = train_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            every, texts = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            for s, e in pieces(texts, PIECE_CHARS):
                langs, (found, own) = every[s:e], ngram_buckets(texts[s:e])
                for lang in np.unique(langs).tolist():
                    mine = langs == lang
                    counts[lang] = counts.get(lang, 0) + np.bincount(found[mine[own]], minlength=BUCKETS)
                    docs_of[lang] = docs_of.get(lang, 0) + int(mine.sum())
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, BUCKETS)), pa.array(np.append(n[at], docs_of[lang]))], ["lang", "bucket", "n"])

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, bucket bigint, n bigint")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).orderBy("lang").limit(MAX_LANGS + 1)
    table = packed.collect()  # a row a language, with BUCKETS + 1 counts at most
    langs = [r["lang"] for r in table]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.zeros((BUCKETS + 1, len(langs)))
    for k, r in enumerate(table):
        counts[r["buckets"], k] = r["n"]
    logs = np.log(counts[:-1] + ALPHA) - np.log(counts[:-1].sum(0) + ALPHA * BUCKETS) if langs else counts[:-1]
    prior = np.log((counts[-1] + 1) / (counts[-1] + 1).sum()) if langs else counts[-1]
    return langs, np.vstack([logs, prior])


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, verdict) for every document; score is the posterior probability of lang_pred; keep: the columns of row."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T, np.float32))

    def run(batch: dict[str, pa.Array]) -> dict[str, object]:
        texts, table = batch["text"].to_pylist(), shared.value
        if not langs:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        parts = [np.empty((0, len(langs)))]
        for s, e in pieces(texts, PIECE_CHARS):
            found, own = ngram_buckets(texts[s:e])
            parts.append(np.stack([np.bincount(own, weights=row[found], minlength=e - s) + row[-1] for row in table], axis=1))
        total = np.concatenate(parts)
        total = np.exp(total - total.max(1, keepdims=True))
        best = total.argmax(1)
        score = total[np.arange(len(texts)), best] / total.sum(1)
        und = [not t or not any(map(str.isalpha, t)) for t in texts]
        return {"lang_pred": ["und" if u else langs[k] for u, k in zip(und, best.tolist(), strict=True)], "score": np.where(und, 0.0, score)}

    return annotate(docs, {"text": f"cast(`{text}` as string)"}, VERDICT, run, keep)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, verdict) for every document, with a model fitted on the training folds of docs."""
    langs, logs = fit(docs)
    return predict(docs, langs, logs, keep=keep)
