"""Document quality: base rules on words, then the log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word unigrams and bigrams are estimated: one from trusted target documents, one from
the whole raw corpus. A document's score is the mean over its n-grams of
log(p_target / p_raw), so it does not depend on its length, and every document is kept exactly
if its score reaches a fixed threshold and the base rules hold. The raw counts cover all documents; the target counts come from
at most TARGET_DOCS trusted documents, those with the smallest id hashes.

Words are [^\\x20\\x09-\\x0D]+. Null or empty text: no words, all counts 0, score 0, base_failed. Very long
texts are counted whole. Repeated rows count each time and get equal verdicts. With an empty corpus or no trusted
documents every ratio is 0, so the base rules decide. Extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelark.llm.common import BATCH_ROWS, annotate
from treelark.llm.resampling import pieces

BUCKETS = 16384
TARGET_DOCS = 20_000
#: Pseudo-counts for each bucket, spread as the raw distribution is.
PRIOR = 20.0
THRESHOLD = -0.05
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = T.StructType([*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def flat_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words in order, the number of words of each text, and the distinct words by code."""
    words = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    code: defaultdict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    codes = np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    return codes, counts, list(code)


def ngram_buckets(codes: np.ndarray, counts: np.ndarray, distinct: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and of all bigrams inside a text, and the text of each."""
    h = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))
    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    words = h[codes]
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[1:] == doc[:-1]
    pairs = (words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ words[1:])[inside] * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return np.concatenate([words >> shift, pairs >> shift]).astype(np.int64), np.concatenate([doc, doc[1:][inside]])


def repeat_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By text: words inside three-word windows that stand twice or more in the text."""
    n = len(codes)
    doc = np.repeat(np.arange(len(counts)), counts)
    if n < 3:
        return np.zeros(len(counts), np.int64)
    ok = np.flatnonzero(doc[2:] == doc[:-2])
    mix = np.uint64(0x9E3779B97F4A7C15)
    key = doc[ok].astype(np.uint64)
    for k in range(3):
        key = (key ^ codes[ok + k].astype(np.uint64)) * mix
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(counts), np.int64)
    near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    some = twice[near] == key
    ok, key = ok[some], key[some]
    order = np.argsort(key, kind="stable")
    at = ok[order]
    same = key[order][1:] == key[order][:-1]
    exact = (doc[at[1:]] == doc[at[:-1]]) & np.logical_and.reduce([codes[at[1:] + k] == codes[at[:-1] + k] for k in range(3)])
    if (same & ~exact).any():  # two windows share a hash: order by the windows themselves
        at = ok[np.lexsort((codes[ok + 2], codes[ok + 1], codes[ok], doc[ok]))]
        exact = (doc[at[1:]] == doc[at[:-1]]) & np.logical_and.reduce([codes[at[1:] + k] == codes[at[:-1] + k] for k in range(3)])
    starts = np.concatenate([at[1:][exact], at[:-1][exact]])
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[starts + k] = True
    return np.bincount(doc[marked], minlength=len(counts))


def dup_lines(text: bytes | None) -> int:
    if not text or b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(texts: list[bytes | None], codes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    blank = b" \t\n\r\x0b\x0c"
    chars = [len(t.translate(None, blank).decode(errors="surrogatepass")) if t else 0 for t in texts]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts]
    return {
        "n_words": counts,
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array([dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeat_words(codes, counts),
    }


def trusted_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> DataFrame:
    """At most `limit` ids of documents with quality 1 and no label of quality 0, by the smallest hashes."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(limit)


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): counts of hashed n-grams over all documents, and over the trusted ones.

    trusted holds at most TARGET_DOCS ids, which bounds what is broadcast. Each task sends one row a bucket at most.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(trusted.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            texts, good = b.column(0).to_pylist(), b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for s, e in pieces(texts):
                found, doc = ngram_buckets(*flat_words(texts[s:e]), buckets)
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[good[s:e][doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    part = marked.select("text", "trusted").mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """log(p_target / p_raw) by bucket; the table has `buckets` rows at most, whatever the corpus."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not raw.sum() or not target.sum():
        return np.zeros(buckets)
    p = (raw + 1) / (raw.sum() + buckets)
    return np.log((target + prior * buckets * p) / (target.sum() + prior * buckets) / p)


def score_documents(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(row, verdict) for every document; keep: the columns of row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def judge(texts: list[bytes | None], table: np.ndarray) -> dict[str, np.ndarray]:
        codes, counts, distinct = flat_words(texts)
        base = base_counts(texts, codes, counts)
        found, doc = ngram_buckets(codes, counts, distinct, len(table))
        total = np.bincount(doc, weights=table[found], minlength=len(texts))
        score = np.round(total / np.maximum(1, np.bincount(doc, minlength=len(texts))), 9)
        failed = (counts < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * counts)
        return base | {"score": score, "base_failed": failed, "kept": ~failed & (score >= threshold)}

    def run(batch: dict[str, pa.Array]) -> dict[str, object]:
        texts = batch["text"].to_pylist()
        parts = [judge(texts[s:e], shared.value) for s, e in pieces(texts)] or [judge([], shared.value)]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return annotate(docs, {"text": "cast(text as binary)"}, VERDICT, run, keep)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(row, verdict) for every document: the model is counted over docs, then each document is judged."""
    ratios = log_ratios(ngram_counts(docs, trusted_ids(labels)))
    return score_documents(docs, ratios, threshold, keep)
