"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in four bits or fewer, one
segment differs in at most one bit (two differing bits in each would make six), so the two share one of the variants of that
segment with a single bit wildcarded. Each distinct fingerprint therefore sends 64 rows, one for each
wildcarded bit; rows are joined on (wildcard, rest of the segment) and every pair that meets is
verified on all 64 bits. Equal fingerprints are one class and are never expanded. Groups of a
variant are compared inside tasks in bounded blocks, hot variants are dealt out over block pairs, and only spanning stars of
the links leave a task. Components are then contracted by distributed rounds.

Null, empty and blank texts have the fingerprint zero and link like any other. Very long texts are hashed whole.
Repeated rows share a class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelark.llm.common import BLOCK_ROWS, Workspace, annotate, by_group, components, runs_of, sifted, stars

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: (first bit, end) of the segments.
SEGMENTS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        h = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]])
        h = np.fromiter([digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, verdict.fp) for every document; keep: the columns of row."""
    kind = T.StructType([T.StructField("fp", T.LongType())])
    return annotate(docs, {"text": f"cast(`{text}` as binary)"}, kind, lambda b: {"fp": [fingerprint(t) for t in b["text"].to_pylist()]}, keep)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of each fingerprint; key is the wildcarded bit and the rest of its segment."""
    bit = F.col("bit")
    cases = None
    for lo, hi in SEGMENTS:
        part = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        left = part.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, cast(bit as int) - {lo})")))
        cases = F.when(bit < hi, left) if cases is None else cases.when(bit < hi, left)
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select((F.shiftleft(bit.cast("long"), 32) + cases).alias("key"), "fp")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def links_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the links inside each (key, part) group of sorted batches."""
    for table, ends in runs_of(batches, ["key", "part"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        sizes = np.diff(ends)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= 16, sizes)
        a, b = [], []
        for step in range(1, min(16, int(sizes.max()))):  # small groups: all pairs a step apart, at once
            ok = (group[step:] == group[:-step]) & small[step:]
            ok &= bits_apart(fp[step:], fp[:-step]) <= MAX_BITS
            a.append(fp[:-step][ok])
            b.append(fp[step:][ok])
        for k in np.flatnonzero(sizes > 16).tolist():
            own = np.unique(fp[ends[k] : ends[k + 1]])
            for i in range(0, len(own), 2 * BLOCK_ROWS):
                for j in range(i, len(own), 2 * BLOCK_ROWS):
                    x, y = own[i : i + 2 * BLOCK_ROWS], own[j : j + 2 * BLOCK_ROWS]
                    both = x if i == j else np.concatenate([x, y])
                    linked = bits_apart(both[:, None], both[None, :]) <= MAX_BITS
                    np.fill_diagonal(linked, False)
                    centre, member = stars(linked)
                    a.append(both[centre])
                    b.append(both[member])
        a, b = np.concatenate(a), np.concatenate(b)
        ok = a != b
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(b[ok].view(np.int64))], ["a", "b"])


def near_duplicates(ws: Workspace, fps: DataFrame, ident: str = "doc_id") -> DataFrame:
    """fps (ident, fp, any others) with component_id, the smallest ident that links of at most MAX_BITS differing bits reach,
    and component, a fingerprint that names the component even if its idents are null."""
    classes = ws.save(fps.groupBy("fp").agg(F.min(ident).alias("least")), "classes")
    rows = by_group(variants(classes.select("fp")), "key", "fp")
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    links = dealt.select("key", "part", "fp").mapInArrow(links_in_groups, "a bigint, b bigint")
    found = components(ws, links, name="simhash").withColumnRenamed("node", "fp")
    least = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = least.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = least.join(roots, "component").select("fp", "component_id", "component")
    return fps.join(ids, "fp").select(*fps.columns, "component_id", "component")


def one_of_each(ws: Workspace, docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, once if its row is repeated."""
    key = F.xxhash64(F.lit(37), "doc_id", "text")
    fps = ws.save(with_fingerprints(docs.select("doc_id", "text", key.alias("key")), keep=["doc_id", "key"]).select("row.*", "verdict.fp"), "fingerprints")
    found = near_duplicates(ws, fps)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("stays"))
    rows = fps.groupBy("key").agg(F.count("*").alias("n")).join(keep, "key", "left")
    touched = ws.save(rows.where("stays is null or n > 1").select(F.col("key").alias("__key"), "stays"), "touched")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("__key"))
    some, rest = sifted(packed, touched, "__key")
    gone, twice = touched.where("stays is null").select("__key"), touched.where("stays").select("__key")
    some = some.join(gone, "__key", "left_anti")
    once = some.join(twice, "__key", "left_semi").dropDuplicates(["__key"])
    return some.join(twice, "__key", "left_anti").unionByName(once).unionByName(rest).select("row.*")
