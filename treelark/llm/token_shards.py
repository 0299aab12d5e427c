"""Token ids in training order: fixed-stride binary shards of packed sequences.

Documents are dealt into parts by a hash of doc_id and ids, ordered in their part by that hash, and stand there end to end; a part is cut into
sequences of SEQ_LEN ids, so only its last sequence may be short. Each document is stored with its part and the number of ids before it, counts by the
stored part number the sequences densely, and a keyed Feistel permutation of the next power of four, walked until it falls below their number, gives
every sequence its global slot. Slots are cut into ranges, one shard file each; a task fills its ranges piece by piece in memory (MOST_BYTES a range
at most) and writes them at a fixed stride, so slot s lies at byte (s mod range) * stride of shard s div range and a reader resumes at any slot
by seeking. A sidecar file holds the number of ids by slot; the rest of a sequence is zero bytes. Pieces of a batch that go to one range travel
together, compressed. The index tells for each piece of a document in which slot and where in it the piece lies.

Shards lie in a folder of their own: `target`, which must not exist, or a scratch folder. When all of them are written and their slots counted, the
file shards.json, which tells the number of sequences, their length and the width of an id, is put beside them: without it a folder isn't whole, with
it a reader needs nothing but the folder. Folders may be named as Spark names them; tasks reach them with pyarrow's file systems, which take
credentials from the machine and not from Hadoop's settings.

Only counts by part reach the driver, MOST_PARTS at most. Shards are written under a temporary name and renamed. A slot depends on the rows alone, not
on how a scan deals them, so a task that is run again writes the same bytes; a slot that is not filled once from end to end, or a missing shard, is an error.

Rows without ids have no pieces. Long texts run over as many sequences as they need. Repeated rows get places of their own. An
empty table gives an empty index and no shards.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelark.llm.common import BATCH_ROWS, Workspace

SEQ_LEN, KEY = 512, 0x5EED
#: Slots of a shard at least, bytes of a shard at most, and the number of shards to aim at between these bounds.
LEAST_RANGE, MOST_BYTES, SHARDS = 4096, 1 << 26, 1024
ROUNDS = 6
#: Documents to aim at in a part, and the number of parts at most.
PART_DOCS, MOST_PARTS = 1024, 1 << 18
#: Bytes of ids that a task gathers before it cuts them into parcels: larger parcels compress better.
PARCEL_BYTES = 1 << 25
#: Tasks that write shards at most.
MOST_WRITERS = 1 << 16
MANIFEST = "shards.json"


class Shards(NamedTuple):
    """The index of the pieces, the folder of the shards and the number of sequences in them."""

    index: DataFrame
    root: str
    sequences: int


def feistel(index: np.ndarray, half: int, key: int) -> np.ndarray:
    """A keyed permutation of the integers below 4 ** half."""
    mask = np.uint64((1 << half) - 1)
    left, right = index >> np.uint64(half), index & mask
    for k in range(ROUNDS):
        salt = np.uint64(int.from_bytes(hashlib.sha256(struct.pack("<QQ", key, k)).digest()[:8], "little"))
        mixed = (right ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
    return (left << np.uint64(half)) | right


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of some of the indices below n, by cycle walking."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    out = feistel(np.asarray(index).astype(np.uint64), half, key)
    while (over := out >= np.uint64(n)).any():
        out[over] = feistel(out[over], half, key)
    return out.astype(np.int64)


def range_of(n: int, stride: int) -> int:
    """Slots of a shard: a power of two that makes about SHARDS shards, within bounds."""
    most = 1 << max(0, (MOST_BYTES // stride).bit_length() - 1)
    return min(most, max(LEAST_RANGE, 1 << max(0, (n // SHARDS).bit_length())))


def parts_of(docs: int) -> int:
    """Parts of so many documents: a power of two that puts about PART_DOCS into one, within bounds."""
    return min(MOST_PARTS, 1 << max(0, (docs // PART_DOCS).bit_length()))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (doc_id, ids, ..) of batches in lists of about PARCEL_BYTES of ids."""
    rows, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows.append(row)
            size += len(row[1])
            if size >= PARCEL_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a folder and its path there. It lacks two usual names of Spark's: s3a:// (s3n://), and dbfs:/, which is mounted at /dbfs."""
    scheme, colon, rest = uri.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif colon and scheme == "dbfs":
        uri = f"/dbfs/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(uri)


def read_manifest(root: str) -> dict[str, int]:
    """sequences, seq_len and width of a whole folder of shards."""
    store, base = store_of(root)
    with store.open_input_file(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def shard_path(root: str, shard: int, kind: str = "bin") -> str:
    return f"{root}/shard-{shard:08d}.{kind}"


LISTS = ["slots", "places", "docs", "firsts", "sizes", "wholes"]
PARCEL = "shard bigint, " + "".join(f"{c} array<bigint>, " for c in LISTS) + "data binary"
INDEX = "slot bigint, place bigint, doc_id bigint, first bigint, n_ids bigint, shard bigint"


def materialise(ws: Workspace, docs: DataFrame, ids: str, width: int, seq_len: int = SEQ_LEN, key: int = KEY, name: str = "shards", parts: int | None = None, target: str | None = None) -> Shards:
    """Writes the shards of docs. Their index (slot, place, doc_id, first, n_ids, shard) has one row for each piece of a document: n_ids of
    its ids from the first-th on lie in the slot from the place-th id on.

    ids: SQL expression of the ids of a row as little-endian binary of `width` bytes each. parts: parts_of(rows) if None, which counts docs.
    target: the folder to keep the shards in; a scratch folder if None.
    """
    spark = docs.sparkSession
    root = target.rstrip("/") if target else f"{ws.root}/{name}"
    store, base = store_of(root)
    if target and store.get_file_info(base).type != fs.FileType.NotFound:
        raise ValueError(f"{root} exists")

    def seal(n: int) -> None:
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps({"sequences": n, "seq_len": seq_len, "width": width}).encode())

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    stride, parts = seq_len * width, parts or parts_of(docs.count())
    rows = docs.select("doc_id", F.expr(ids).alias("ids"))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(37), "doc_id", "ids")).withColumn("part", F.pmod("hash", F.lit(parts)))
    rows = rows.withColumn("n", F.floor(F.coalesce(F.octet_length("ids"), F.lit(0)) / width)).where("n > 0")
    before = Window.partitionBy("part").orderBy("hash", "doc_id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    rows = ws.save(rows.select("doc_id", "ids", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at")), f"{name}-ids", compression="zstd")
    totals = np.zeros(parts, np.int64)
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect():
        totals[r["part"]] = r["n"]
    counts = -(-totals // seq_len)
    n = int(counts.sum())
    size = range_of(n, stride)
    if not n:
        seal(0)
        return Shards(spark.createDataFrame([], INDEX), root, 0)
    shared = spark.sparkContext.broadcast((np.cumsum(counts) - counts, totals))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, total = shared.value
        longs = pa.list_(pa.int64())
        for rows_ in gathered(batches):
            doc, first, place, m, whole, payload, index = [], [], [], [], [], [], []
            for i, x, part, at in rows_:
                end = at + len(x) // width
                for k in range(at // seq_len, (end - 1) // seq_len + 1):
                    a, z = max(at, k * seq_len), min(end, (k + 1) * seq_len)
                    doc.append(i)
                    first.append(a - at)
                    place.append(a - k * seq_len)
                    m.append(z - a)
                    whole.append(min(seq_len, int(total[part]) - k * seq_len))
                    payload.append(x[(a - at) * width : (z - at) * width])
                    index.append(int(starts[part]) + k)
            slot = permute(np.array(index), n, key)
            order = np.argsort(slot, kind="stable")
            shard = slot[order] // size
            ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(order))
            out, start = [], 0
            for end in ends.tolist():
                own = order[start:end].tolist()
                data = zstandard.compress(b"".join([payload[k] for k in own]), 3)
                out.append((int(shard[start]), slot[own], *([column[k] for k in own] for column in (place, doc, first, m, whole)), data))
                start = end
            kinds = [pa.int64(), *[longs] * len(LISTS), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", *LISTS, "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        store.create_dir(base, recursive=True)
        at, filled, pieces = -1, bytearray(), []

        def put(kind: str, data: bytes) -> None:
            final = shard_path(base, at, kind)
            temp = f"{final}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(temp) as f:
                f.write(data)
            store.move(temp, final)

        def finish() -> pa.RecordBatch:
            count = min(size, n - at * size)
            slot, place, first, m, whole = (np.concatenate([p[c] for p in pieces]) for c in ("slots", "places", "firsts", "sizes", "wholes"))
            doc = pa.concat_arrays([p["docs"] for p in pieces])
            order = np.lexsort((place, slot))
            slot, place, first, m, whole = slot[order], place[order], first[order], m[order], whole[order]
            opens, end = np.append(True, slot[1:] != slot[:-1]), place + m
            closes = np.append(opens[1:], True)
            sound = (place[opens] == 0).all() and (place[1:] == end[:-1])[~opens[1:]].all() and (end[closes] == whole[closes]).all()
            if not sound or not np.array_equal(slot[opens], np.arange(at * size, at * size + count)):
                raise ValueError(f"the pieces don't fill the {count} slots of shard {at} once each")
            put("bin", memoryview(filled)[: count * stride])
            put("len", whole[opens].astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place), doc.take(pa.array(order)), pa.array(first), pa.array(m), pa.array(np.full(len(slot), at))], ["slot", "place", "doc_id", "first", "n_ids", "shard"])

        for b in batches:
            shards, data = b.column(0).to_pylist(), b.column(len(LISTS) + 1)
            for i, shard in enumerate(shards):
                if shard != at:
                    if at >= 0:
                        yield finish()
                    at, filled, pieces = shard, bytearray(size * stride), []
                piece = {c: x if c == "docs" else x.to_numpy() for k, c in enumerate(LISTS) if (x := b.column(k + 1)[i].values) is not None}
                raw, k = zstandard.decompress(data[i].as_py()), 0
                starts = (piece["slots"] - at * size) * stride + piece["places"] * width
                for start, m in zip(starts.tolist(), (piece["sizes"] * width).tolist(), strict=True):
                    filled[start : start + m] = raw[k : k + m]
                    k += m
                pieces.append(piece)
        if at >= 0:
            yield finish()

    dealt = rows.select("doc_id", "ids", "part", "at").mapInArrow(cut, PARCEL).repartition(max(1, min(-(-n // size), MOST_WRITERS)), "shard").sortWithinPartitions("shard")
    index = ws.save(dealt.mapInArrow(write, INDEX), f"{name}-index")
    if (written := index.where("place = 0").count()) != n:
        raise ValueError(f"{written} of {n} slots are written")
    ws.drop(f"{name}-ids")
    seal(n)
    return Shards(index, root, n)


def with_digests(shards: Shards, width: int, seq_len: int = SEQ_LEN) -> DataFrame:
    """The index with the SHA-256 of each piece's ids, read back from the shards: the span of a batch's pieces in a shard by one read, a whole shard
    (MOST_BYTES) at most."""
    stride, root = seq_len * width, shards.root
    size = range_of(shards.sequences, stride)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for b in batches:
            slot, place, count = (b.column(k).to_numpy() for k in (0, 1, 4))
            digests: list[str] = [""] * len(slot)
            order = np.argsort(slot, kind="stable")
            first = 0
            for last in np.append(np.flatnonzero(np.diff(slot[order] // size)) + 1, len(order)).tolist() if len(order) else []:
                own = order[first:last]
                low, high = int(slot[own[0]]), int(slot[own[-1]]) + 1
                with store.open_input_file(shard_path(base, low // size)) as f:
                    f.seek(low % size * stride)
                    data = memoryview(f.read((high - low) * stride))
                at = (slot[own] - low) * stride + place[own] * width
                for k, a, z in zip(own.tolist(), at.tolist(), (at + count[own] * width).tolist(), strict=True):
                    digests[k] = hashlib.sha256(data[a:z]).hexdigest()
                first = last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], [*b.schema.names, "ids_sha256"])

    return shards.index.mapInArrow(run, INDEX + ", ids_sha256 string")


def read_slots(root: str, first: int, count: int, n: int, width: int, seq_len: int = SEQ_LEN) -> list[bytes]:
    """Sequences of consecutive slots, by seeking; n is the number of all sequences."""
    store, base = store_of(root)
    stride, out = seq_len * width, []
    size = range_of(n, stride)
    while count > 0 and first < n:
        shard, k = divmod(first, size)
        take = min(count, size - k, n - first)
        with store.open_input_file(shard_path(base, shard)) as f, store.open_input_file(shard_path(base, shard, "len")) as g:
            f.seek(k * stride)
            g.seek(4 * k)
            lengths = np.frombuffer(g.read(4 * take), "<u4")
            out += [f.read(stride)[: m * width] for m in lengths.tolist()]
        first, count = first + take, count - take
    return out
