"""Vector compression: each of PARTS equal parts of a vector is replaced by the index of its nearest codebook entry.

Components are floored to integers in steps of 1 / SCALE. Codebooks start as the parts of the ENTRIES smallest ids and are refined in ROUNDS
rounds: every part goes to its nearest entry, and entries become the floored means of their parts.

Equal parts are one row with their number, stored once in lexicographic order, so a hot group of copies costs one row. A run of them is a trie by
its common prefixes: a depth-first traversal carries, for each node, the distances of its prefix to all entries at once, so that what
parts share is summed once; subtrees of at most SUBTREE leaves are summed level by level in arrays. At the leaves the nearest entry is taken, and
counts and component sums are weighted by the number of copies. A task sends one row an entry, whatever it has read, and the driver sees
the sums of entries only. The last assignment walks a trie of each batch of vectors, without a shuffle.

Vectors that are null or hold a null or non-finite component are dropped. Shorter vectors, empty ones too, count as filled up with zeros to the
longest, and that to a multiple of PARTS. Steps beyond 2^26 count as 2^26. Ties between entries go to the lower index; of rows with equal ids, those
of smaller components come first; null ids come last. With fewer than ENTRIES rows there are as many entries as rows. Repeated rows are rows of
their own with equal codes. Null labels are one label. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelark.llm.common import Workspace, annotate, bounded

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Leaves of a subtree that is summed level by level; below it a traversal goes node by node.
SUBTREE = 4096
STEPS = 1 << 26
CODED = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


def integers(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vectors with the array `steps` in place of the embedding; those that can't be compressed are gone."""
    fit = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    step = lambda x: F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(x.cast("double") * SCALE))).cast("int")
    return vectors.where(F.col(embedding).isNotNull() & fit).withColumn("steps", F.transform(embedding, step)).drop(embedding)


def common_prefixes(parts: np.ndarray) -> np.ndarray:
    """For each row but the first of distinct sorted rows: the length of the prefix that it shares with the row above."""
    return (parts[1:] != parts[:-1]).argmax(axis=1)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of the book (entries x components) and its squared distance, for distinct rows in lexicographic order."""
    n, width = parts.shape
    shared = common_prefixes(parts)
    entry, least = np.empty(n, np.int64), np.empty(n, np.int64)
    stack = [(0, n, 0, np.zeros((1, len(book)), np.int64))] if n else []
    while stack:
        start, end, level, sums = stack.pop()  # rows that share a prefix of `level` components, and its distances
        if end - start <= SUBTREE or level == width:
            above = np.zeros(1, np.int64)
            for k in range(level, width):
                heads = np.concatenate([[start], start + 1 + np.flatnonzero(shared[start : end - 1] <= k)])
                parent = np.searchsorted(above + start, heads, side="right") - 1
                sums = sums[parent] + (parts[heads, k][:, None] - book[:, k]) ** 2
                above = heads - start
            entry[start:end], least[start:end] = sums.argmin(axis=1), sums.min(axis=1)
            continue
        heads = np.concatenate([[start], start + 1 + np.flatnonzero(shared[start : end - 1] <= level), [end]])
        children, first = [], start
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if b - first > SUBTREE and a > first:  # siblings that fill a subtree go down together
                children.append((first, a, level, sums))
                first = a
            if b - a > SUBTREE:
                children.append((a, b, level + 1, sums + (parts[a, level] - book[:, level]) ** 2))
                first = b
        if first < end:
            children.append((first, end, level, sums))
        stack += reversed(children)
    return entry, least


def part_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def entry_sums(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, entry, n, sums) over the distinct parts (pos, part, n): a row an entry of each task, then of all."""
    shared = parts.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        count, total = np.zeros(b.shape[:2], np.int64), np.zeros(b.shape, np.int64)
        for batch in batches:
            pos, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            part = part_matrix(batch.column(1), b.shape[2])
            for p in np.unique(pos).tolist():
                own = pos == p
                entry, _ = nearest(part[own], b[p])
                np.add.at(count[p], entry, n[own])
                np.add.at(total[p], entry, part[own] * n[own][:, None])
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * b.shape[2]), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), sums], ["pos", "entry", "n", "sums"])

    found = parts.mapInArrow(run, "pos bigint, entry bigint, n bigint, sums array<bigint>")
    return found.select("pos", "entry", "n", F.posexplode("sums").alias("k", "v")).groupBy("pos", "entry", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def refined(parts: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts x entries x components) after so many rounds; unused entries stay."""
    for _ in range(rounds):
        books = books.copy()
        for r in entry_sums(parts, books).collect():  # parts x entries x components rows
            books[r["pos"], r["entry"], r["k"]] = r["v"] // r["n"]
    return books


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, verdict) for every row with `steps` of full length: its code and its summed squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batch: dict[str, pa.Array]) -> dict[str, object]:
        b = shared.value
        steps = part_matrix(batch["steps"], b.shape[0] * b.shape[2])
        error, digits = np.zeros(len(steps), np.int64), []
        for p in range(b.shape[0]):
            part = steps[:, p * b.shape[2] : (p + 1) * b.shape[2]]
            order = np.lexsort(part.T[::-1])
            part = part[order]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]).any(axis=1)
            entry, least = nearest(part[new], b[p])
            leaf = np.empty(len(part), np.int64)
            leaf[order] = np.cumsum(new) - 1
            error += least[leaf]
            digits.append(np.array([f"{e:02x}" for e in range(b.shape[1])])[entry[leaf]])
        code = digits[0]
        for d in digits[1:]:
            code = np.char.add(code, d)
        return {"code": code.tolist(), "error": error}

    return annotate(vectors, {"steps": "steps"}, CODED, run, [c for c in vectors.columns if c != "steps"])


def digest(books: np.ndarray) -> str:
    """Of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(ws: Workspace, vectors: DataFrame, ident: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, code, error) of every vector that is kept, and the codebooks, as integers. vectors: `embedding` and an id."""
    named = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != "embedding"]).alias("row"), "embedding")
    kept = ws.save(integers(named), "steps")
    longest = kept.agg(F.max(F.size("steps"))).first()[0]
    if longest is None:
        return kept.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 1), np.int64)
    width = max(1, -(-longest // parts))
    filled = F.concat("steps", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("steps")))
    full = kept.withColumn("steps", filled)
    first = full.orderBy(F.col(f"row.`{ident}`").asc_nulls_last(), "steps").limit(entries).select("steps").collect()
    books = np.array([r["steps"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("steps", p * width + 1, width))
    distinct = full.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("n"))
    distinct = ws.save(distinct.sortWithinPartitions("pos", "part"), "parts")
    books = refined(distinct, books, rounds)
    return encoded(full, books).select("row.row", "verdict.*"), books


def with_label_errors(ws: Workspace, coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with the sum of errors over all rows of the same label, nulls together."""
    coded = ws.save(coded, "coded")
    sums = coded.groupBy(F.col(f"row.`{label}`").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(bounded(sums), F.col(f"row.`{label}`").eqNullSafe(F.col("__label"))).drop("__label")


def oracle(table: str = "embeddings") -> str:
    """The result in DuckDB SQL for vectors of equal length, every distance computed by itself."""
    sql = f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM {table}
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS part FROM kept, (SELECT unnest(range(0, {PARTS})) AS p)),
parts AS (SELECT p, part, count(*) AS n FROM cut GROUP BY p, part),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept ORDER BY vec_id, v LIMIT {ENTRIES}),
book0 AS (SELECT p, e, part AS c FROM cut JOIN first USING (r))"""
    near = "list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i])))"
    for k in range(ROUNDS + 1):
        sql += f""",
near{k} AS MATERIALIZED (SELECT p, part, n, min(struct_pack(d := d, e := e)) AS m FROM (SELECT p, part, n, e, {near}::BIGINT AS d FROM parts JOIN book{k} USING (p)) GROUP BY p, part, n)"""
        if k < ROUNDS:
            sql += f""",
mean{k} AS (SELECT p, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, sum(n * part[i]) AS s, sum(n) AS n FROM near{k}, unnest(range(1, len(part) + 1)) AS u(i) GROUP BY p, m.e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))"""
    return f"""{sql},
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM cut JOIN near{ROUNDS} USING (p, part) GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded JOIN kept USING (r)"""
