"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A unit vector o is turned by a random matrix with orthonormal rows into a longer vector and kept as its signs x (scaled to
unit length) with the factor f = <x, Ro>. For another unit vector q, <x, Rq> / f estimates <o, q> without bias, with
a standard error of sqrt(1 - <o, q>^2) * sqrt(1 - f^2) / (f * sqrt(bits - 1)). A pair whose estimate lies more than
EPSILON such errors below the threshold is dropped on its codes alone; vectors are fetched only for the rest, whose cosine
is then computed in double precision. Pairs meet in bands of sign bits of further random directions, as
many as give a pair at the threshold a chance of MISS at most to share none; the bits of a band follow the number of vectors.

Equal vectors are one class with a size, so copies are never expanded into pairs. Hot bands are dealt out over
block pairs; a pair counts in the first band that it shares, so n_links is a count of distinct partners. Only counts and
spanning stars leave a task.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
lengths never link. Repeated rows are copies of each other. A null vec_id is kept if its vector has no class with an id. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.llm.common import Workspace, by_group, components, runs_of, stars

THRESHOLD, EPSILON, MISS = 0.95, 4.0, 0.001
CODE_BITS, SEED = 256, 7
SMALL = 16


def bands_for(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a band, bands) for n vectors: about four vectors a bucket."""
    bits = min(24, max(10, math.ceil(math.log2(max(n, 2))) - 2))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    bits = max(CODE_BITS, -(-dim // 64) * 64)
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dim)))
    return np.ascontiguousarray(q.T, dtype=np.float32)


@functools.lru_cache(maxsize=8)
def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((dim, count)).astype(np.float32)


def units(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """One integer a band, by vector."""
    signs = (unit.astype(np.float32) @ directions(unit.shape[1], bits * bands)) > 0
    return signs.reshape(len(unit), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned vectors, and their factors."""
    turned = unit.astype(np.float32) @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def signs(packed: np.ndarray) -> np.ndarray:
    return (np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1) / math.sqrt(packed.shape[1] * 8)


def least_estimate(factor: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """The estimate below which a pair is surely under the threshold, by the factor of the coded vector."""
    error = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * math.sqrt(bits - 1))
    return threshold - EPSILON * error - 0.01  # 0.01: for the 8-bit query side


def pairs_in_groups(sizes: np.ndarray, starts: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs inside the small groups."""
    total = int(sizes.sum())
    group = np.repeat(np.arange(len(sizes)), sizes)
    ok = np.repeat(small, sizes)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, min(SMALL, int(sizes.max()))):
        at = np.flatnonzero((group[step:] == group[: total - step]) & ok[step:])
        a.append(at)
        b.append(at + step)
    return np.concatenate(a), np.concatenate(b)


def band_rows(vectors: DataFrame, bits: int, bands: int) -> DataFrame:
    """(key, rep, code, factor, query): one row a band and vector; query is the unit vector in 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, sizes = b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                u = units(np.array(b.column(1).take(pa.array(at)).flatten()).reshape(len(at), dim))
                keys, (packed, factor) = band_keys(u, bits, bands), codes(u)
                peak = np.abs(u).max(1)
                small = np.round(u / peak[:, None] * 127).astype(np.int8)
                spread = (keys + (np.arange(bands) << 32)).ravel()
                times = lambda x: np.repeat(x, bands, axis=0)
                raw = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1]), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(times(rep[at])), raw(times(packed)), pa.array(times(factor).astype(np.float32)), raw(times(small)), pa.array(times(peak / 127).astype(np.float32))], ["key", "rep", "code", "factor", "query", "scale"])

    return vectors.select("rep", "embedding").mapInArrow(run, "key bigint, rep bigint, code binary, factor float, query binary, scale float")


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    offsets = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4)
    return np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(flat), -1)


def candidates(threshold: float):
    """Of sorted groups (key, part): the members with a partner that the codes can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in runs_of(batches, ["key", "part"]):
            n, hit = table.num_rows, np.zeros(table.num_rows, bool)
            width = np.diff(np.frombuffer(table.column("query").combine_chunks().buffers()[1], np.int32, n + 1))
            sizes, starts = np.diff(ends), ends[:-1]
            if (width == width[0]).all():
                code, query = matrix(table.column("code"), np.uint8), matrix(table.column("query"), np.int8)
                factor, scale = table.column("factor").to_numpy(), table.column("scale").to_numpy()
                least = least_estimate(factor, code.shape[1] * 8, threshold)
                turn = rotation(query.shape[1])
                a, b = pairs_in_groups(sizes, starts, sizes <= SMALL)
                for k in range(0, len(a), 20_000):
                    i, j = a[k : k + 20_000], b[k : k + 20_000]
                    turned = (query[j] * scale[j][:, None]) @ turn
                    near = np.einsum("ij,ij->i", signs(code[i]), turned) / factor[i] >= least[i]
                    hit[i[near]] = hit[j[near]] = True
                for g in np.flatnonzero(sizes > SMALL).tolist():
                    s, e = int(ends[g]), int(ends[g + 1])
                    x = signs(code[s:e])
                    for k in range(s, e, 1024):
                        turned = (query[k : min(e, k + 1024)] * scale[k : min(e, k + 1024), None]) @ turn
                        near = (x @ turned.T) / factor[s:e, None] >= least[s:e, None]
                        near[np.arange(k - s, min(e, k + 1024) - s), np.arange(min(e, k + 1024) - k)] = False
                        hit[s:e] |= near.any(1)
                        hit[k : min(e, k + 1024)] |= near.any(0)
            else:  # lengths differ: leave the group to the exact check
                hit[:] = True
            if hit.any():
                t = table.select(["key", "part", "rep", "block", "diag"]).filter(pa.array(hit)).combine_chunks()
                yield from t.to_batches()

    return run


def exact_links(bits: int, bands: int, threshold: float):
    """Of sorted groups (key, part) with vectors: partners counted by class size, and spanning stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in runs_of(batches, ["key", "part"]):
            lists = table.column("embedding").combine_chunks()
            dims = np.diff(lists.offsets.to_numpy())
            rep, size, block = (table.column(c).to_numpy() for c in ("rep", "size", "block"))
            band, diag = table.column("key").to_numpy() >> 32, table.column("diag").to_numpy()
            out = [[], [], []]
            for g in range(len(ends) - 1):
                for dim in np.unique(dims[ends[g] : ends[g + 1]]).tolist():
                    at = ends[g] + np.flatnonzero(dims[ends[g] : ends[g + 1]] == dim)
                    if len(at) < 2:
                        continue
                    u = units(np.array(lists.take(pa.array(at)).flatten()).reshape(len(at), dim))
                    keys, own = band_keys(u, bits, bands), int(band[at[0]])
                    linked = np.zeros((len(at), len(at)), bool)
                    for k in range(0, len(at), 256):
                        rows = slice(k, k + 256)
                        near = u[rows] @ u.T >= threshold - 1e-9
                        i, j = np.nonzero(near)
                        i += k
                        if not diag[at[0]]:
                            ok = block[at[i]] != block[at[j]]
                            i, j = i[ok], j[ok]
                        i, j = i[i != j], j[i != j]
                        cosine = np.concatenate([np.einsum("ij,ij->i", u[i[m : m + 50_000]], u[j[m : m + 50_000]]) for m in range(0, len(i), 50_000)]) if len(i) else np.empty(0)
                        first = np.ones(len(i), bool)  # the pair belongs to the first band that it shares
                        for c in range(own):
                            first &= keys[i, c] != keys[j, c]
                        ok = first & (cosine >= threshold)
                        linked[i[ok], j[ok]] = True
                    partners = linked @ size[at]
                    m = np.flatnonzero(partners)
                    centre, member = stars(linked)
                    out[0] += [rep[at[m]], rep[at[centre]]]
                    out[1] += [np.full(len(m), -1), rep[at[member]]]
                    out[2] += [partners[m], np.zeros(len(centre), np.int64)]
            if out[0]:
                a, b, n = (np.concatenate(x).astype(np.int64) for x in out)
                kind = np.concatenate([np.full(len(x), k % 2) for k, x in enumerate(out[0])]).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(n)], ["link", "a", "b", "n"])

    return run


def valid(embedding: str = "embedding") -> str:
    """SQL: the vector is not null, not zero, and all its components are finite."""
    e = f"`{embedding}`"
    finite = f"forall({e}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return f"coalesce({finite} and exists({e}, x -> x <> 0), false)"


def near_duplicates(ws: Workspace, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("h")).where(F.expr(valid()))
    classes = ws.save(rows.groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")).where("rep is not null"), "classes")
    bits, bands = bands_for(classes.count(), threshold)
    spread = by_group(band_rows(classes, bits, bands), "key", "rep")
    dealt = spread.repartition("key", "part").sortWithinPartitions("key", "part")
    order = ["key", "part", "rep", "block", "diag", "code", "factor", "query", "scale"]
    some = ws.save(dealt.select(*order).mapInArrow(candidates(threshold), "key bigint, part bigint, rep bigint, block bigint, diag boolean"), "candidates")
    full = some.join(classes.select("rep", "size", "embedding"), "rep").repartition("key", "part").sortWithinPartitions("key", "part")
    exact = full.select("key", "part", "rep", "block", "diag", "size", "embedding").mapInArrow(exact_links(bits, bands, threshold), "link boolean, a bigint, b bigint, n bigint")
    exact = ws.save(exact, "exact")
    counts = exact.where("not link").groupBy("a").agg(F.sum("n").alias("partners"))
    found = components(ws, exact.where("link").select("a", "b"), name="embedding")
    by_class = classes.join(counts, classes["rep"] == counts["a"], "left").join(found, classes["rep"] == found["node"], "left")
    by_class = by_class.select("h", F.col("embedding").alias("vector"), (F.coalesce("partners", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "rep").alias("root"))
    all_rows = vectors.select("vec_id", "embedding", F.when(F.expr(valid()), F.xxhash64("embedding")).alias("h"))
    joined = all_rows.join(by_class, (all_rows["h"] == by_class["h"]) & (all_rows["embedding"] == by_class["vector"]), "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL: all pairs, and the smallest vec_id that links reach. For small tables only."""
    return f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS size FROM embeddings
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / a.size / b.size >= {threshold}
    ), reach AS (
        SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), least AS (
        SELECT a, min(b) AS b FROM reach GROUP BY a
    ), counts AS (
        SELECT a, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
    FROM v LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
    """
