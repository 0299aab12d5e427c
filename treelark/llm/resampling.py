"""Importance resampling of documents towards a target distribution.

Features of a text are its words (A-Z lower-cased) and pairs of consecutive words, repeats counted, in BUCKETS buckets by crc32. The gain of a
bucket is the floored 1000-fold logarithm of its smoothed share among the features of all target texts over its share among those of all
documents; a document's weight is the floored mean of its gains, looked up in one array. A key of the document's id and a seed gives Gumbel noise;
the documents with the highest sums are a draw without replacement in proportion to the exponentiated weights.

The cutoff among N documents is found exactly by weighted median-of-medians selection: in each round every partition sends the median of its
remaining keys and their number, the median of these, weighted by the numbers, is the next pivot, and the side of it that can't hold the
cutoff, a quarter of the remaining keys or more, is discarded. Keys lie sorted in the files, so a round reads the pages of what remains. What
reaches the driver is two rows a partition and round, and in the end at most LAST keys. Only winners are sorted, by ranges over all executors.

Null and empty texts have no features, weight 0 and too few words to be drawn. Ties in score go to the smaller id, then to rows with fewer
features, then in an order of their own; a null id is hashed as the empty text and sorts last. Repeated rows are rows of their own. No target texts: all gains come from smoothing.
An empty table gives an empty result. Very long texts are read whole, in pieces of a batch. Extra columns pass through, whatever they are called.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelark.llm.common import BATCH_ROWS, Workspace, annotate, bounded

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, "7"
#: Keys left when the rest of a selection is sorted on the driver.
LAST = 64
#: Bytes of text whose words are held as arrays at a time.
PIECE_BYTES = 1 << 22
#: Lower-cases A-Z; all ASCII but letters and digits parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
VERDICT = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def _after(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


@functools.lru_cache(maxsize=1)
def _steps() -> list[np.ndarray]:
    """By k: what 2^k zero bytes make of a crc32, as four tables by its bytes. The change is linear, so tables double by applying themselves."""
    one = np.array([[zlib.crc32(b"\0", b << 8 * k) ^ zlib.crc32(b"\0") for b in range(256)] for k in range(4)], np.uint32)
    found = [one]
    for _ in range(31):
        found.append(_after(found[-1], found[-1]))
    return found


def followed(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of texts put together, from those of the first and second parts and the bytes of the second."""
    out, k = first.copy(), 0
    while (left := size >> k).any():
        at = np.flatnonzero(left & 1)
        out[at] = _after(out[at], _steps()[k])
        k += 1
    return out ^ second


def pieces(texts: list[bytes | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of about `limit` bytes; a longer text is a range of its own."""
    start = held = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def feature_buckets(texts: list[bytes | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the text of each, and the number of words of each text."""
    words = [t.translate(WORDS).split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    code: defaultdict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    codes = np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    alone = np.fromiter(map(zlib.crc32, code), np.uint32, len(code))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in code), np.uint32, len(code))
    size = np.fromiter((len(w) + 1 for w in code), np.int64, len(code))
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = followed(alone[codes[at]], spaced[codes[at + 1]], size[codes[at + 1]])
    return np.concatenate([alone[codes], pairs]).astype(np.int64) % buckets, np.concatenate([doc, doc[at]]), counts


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket. A task sends a row a bucket at most, and so do all of them to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in pieces(texts):
                n += np.bincount(feature_buckets(texts[s:e], buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    part = df.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    found = np.zeros(buckets, np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    b = len(raw)
    up, down = (target + 1.0) * float(raw.sum() + b), (raw + 1.0) * float(target.sum() + b)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """(row, verdict) for every document: n_words, n_features and the floored mean of its gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batch: dict[str, pa.Array]) -> dict[str, object]:
        texts, table, found = batch["text"].to_pylist(), shared.value, {c.name: [] for c in VERDICT}
        for s, e in pieces(texts):
            bucket, doc, words = feature_buckets(texts[s:e], len(table))
            n = np.bincount(doc, minlength=e - s)
            total = np.bincount(doc, weights=table[bucket], minlength=e - s).astype(np.int64)
            for c, v in zip(found, (words, n, total // np.maximum(n, 1)), strict=True):
                found[c].append(v)
        return {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in found.items()}

    return annotate(docs, {"text": "cast(text as binary)"}, VERDICT, run, keep)


def noise(ident: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of `seed:id`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


#: What keys are sorted by, all ascending: lost is the score with its sign turned.
KEY = ["lost", "id", "n_features", "at"]
Key = tuple[int, ...]


def up_to(key: Key, strictly: bool = False) -> Column:
    """Whether a row's key is at or before this one."""
    out = F.lit(not strictly)
    for c, v in reversed(list(zip(KEY, key, strict=True))):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return (F.col(KEY[0]) <= key[0]) & out  # the first conjunct is pushed down to the sorted files


def medians(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list[tuple[bool, int, Key]]:
    """Of every partition: its keys between low and high (both left out) before and behind the pivot, their number and their median."""
    left = keys
    if low is not None:
        left = left.where((F.col(KEY[0]) >= low[0]) & ~up_to(low))
    if high is not None:
        left = left.where(up_to(high, strictly=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(k).to_numpy() for k in range(len(KEY))]) for b in batches if b.num_rows]
        k = np.concatenate(parts, axis=1) if parts else np.empty((len(KEY), 0), np.int64)
        k = k[:, np.lexsort(k[::-1])]
        first, behind = k.shape[1], k.shape[1]
        if pivot is not None:
            before = np.zeros(k.shape[1], bool)
            same = np.ones(k.shape[1], bool)
            for v, p in zip(k, pivot, strict=True):
                before |= same & (v < p)
                same &= v == p
            first, behind = int(before.sum()), int((before | same).sum())
        found = [(side, b - a, *k[:, (a + b - 1) // 2].tolist()) for side, a, b in ((False, 0, first), (True, behind, k.shape[1])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), [pa.bool_(), *[pa.int64()] * (1 + len(KEY))], strict=True)] if found else [pa.array([], pa.bool_())] + [pa.array([], pa.int64())] * (1 + len(KEY)), ["side", "n", *KEY])

    schema = "side boolean, n bigint, " + ", ".join(f"{c} bigint" for c in KEY)
    return [(r["side"], r["n"], tuple(r[c] for c in KEY)) for r in left.select(*KEY).mapInArrow(run, schema).collect()]


def weighted_median(found: list[tuple[int, Key]]) -> Key:
    """The first key at which half of the weight lies at or before it."""
    half, reached = sum(n for n, _ in found), 0
    for n, key in sorted(found, key=lambda x: x[1]):
        reached += 2 * n
        if reached >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, wanted: int, last: int = LAST) -> Key:
    """The key that `wanted` keys are at or before, 1 <= wanted <= their number. Keys are distinct, and best kept sorted within files."""
    low = high = pivot = None
    before = 0  # keys that surely lie before what remains
    side = False
    while True:
        found = medians(keys, low, high, pivot)
        if pivot is not None:
            first = sum(n for s, n, _ in found if not s)
            if before + first + 1 == wanted:
                return pivot
            side = before + first < wanted
            if side:
                before, low = before + first + 1, pivot
            else:
                high = pivot
        left = [(n, key) for s, n, key in found if s == side]
        if sum(n for n, _ in left) <= last:
            rest = keys if low is None else keys.where((F.col(KEY[0]) >= low[0]) & ~up_to(low))
            rest = rest if high is None else rest.where(up_to(high, strictly=True))
            return sorted(tuple(r) for r in rest.select(*KEY).collect())[wanted - before - 1]
        pivot = weighted_median(left)


def ranked(ws: Workspace, df: DataFrame, order: list[str]) -> DataFrame:
    """df with its rank 1, 2, 3... by distinct keys: sorted by ranges over all tasks, and numbered by the sizes of the ranges before."""
    sorted_ = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    placed = ws.save(sorted_, "sorted")
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    starts = ws.spark.createDataFrame(offsets, "__part int, __start bigint")
    rank = F.col("__start") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(bounded(starts), "__part").withColumn("rank", rank).drop("__part", "__place", "__start")


def resample(ws: Workspace, docs: DataFrame, target: DataFrame, ident: str = "doc_id", percent: int = PERCENT, seed: str = SEED, min_words: int = MIN_WORDS, keep: list[str] | None = None, last: int = LAST) -> DataFrame:
    """(row, n_words, n_features, weight, score, rank) of every document; rank is null for those that aren't drawn.

    docs: `text` and a bigint id; target: `text`. Of N documents with min_words words or more, floor(percent N / 100) are drawn. keep: the columns of row.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    columns = list(dict.fromkeys([*(docs.columns if keep is None else keep), ident]))
    weighed = weigh(docs, gain, columns).select("row", "verdict.*", F.col(f"row.`{ident}`").alias("given"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("given"), seed)).withColumns(
        {"lost": -F.col("score"), "id": F.coalesce("given", F.lit((1 << 63) - 1)), "at": F.monotonically_increasing_id()}
    )
    scored = ws.save(scored.drop("given"), "scored")
    able = F.col("n_words") >= min_words
    keys = ws.save(scored.where(able).select(*KEY).sortWithinPartitions(*KEY), "keys")
    wanted = keys.count() * percent // 100
    out = ["row", "n_words", "n_features", "weight", "score", "rank"]
    unranked = scored.withColumn("rank", F.lit(None).cast("long"))
    if not wanted:
        return unranked.select(*out)
    drawn = able & up_to(cutoff(keys, wanted, last))
    return ranked(ws, scored.where(drawn), KEY).select(*out).unionByName(unranked.where(~drawn).select(*out))


def oracle(table: str = "documents", target: str = "benchmark") -> str:
    """The result in DuckDB SQL, by sorting all rows; crc32 is written out by bits."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    features = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    byte = "(strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1"
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
    table_of = f"list_transform(range(0, 256), lambda v: list_reduce(list_concat([v::BIGINT], range(0, 8)), lambda c, k: {bit}))"
    step = "xor(any_table[(xor(c, b) & 255) + 1], c // 256)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {table}),
goal AS (SELECT {words} AS w FROM {target}),
raw AS (SELECT r, unnest({features}) AS f FROM docs),
aimed AS (SELECT unnest({features}) AS f FROM goal),
counted AS (SELECT f, sum(a) AS s, sum(b) AS t FROM (SELECT f, 1 AS a, 0 AS b FROM raw UNION ALL SELECT f, 0, 1 FROM aimed) GROUP BY f),
coded AS (SELECT f, s, t, hex(encode(f)) AS x, {table_of} AS any_table FROM counted),
bytes AS (SELECT f, s, t, any_table, list_transform(range(0, len(x) // 2), lambda i: ({byte})::BIGINT) AS bs FROM coded),
crcs AS (SELECT f, s, t, xor(list_reduce(list_concat([4294967295::BIGINT], bs), lambda c, b: {step}), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes),
sums AS (SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM crcs GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS g FROM sums, totals),
weighed AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN crcs USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
 coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM docs LEFT JOIN weighed USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n_all FROM scored WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n_all // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (r)"""
