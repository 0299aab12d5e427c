"""What the training-data operators share: scratch tables, Arrow annotation, splitting of hot groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch: whole texts may be long, and a Python worker holds one batch at a time.
BATCH_ROWS = 1000
#: Largest group of rows that one task compares among themselves; larger groups are dealt out in blocks.
BLOCK_ROWS = 1024
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Scratch tables in the shared folder that the cluster names in spark.checkpoint.dir.

    A table that is written and read again cuts the lineage and survives lost executors.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="spark-checkpoint-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/treelark-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """df, written and read again; the shuffle files of the write are removed when it ends."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**options).parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of a table that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 1 << 26


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows and bytes were counted to be few."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size += F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size += 32 * F.greatest(F.size(f"`{f.name}`"), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def annotate(
    df: DataFrame, inputs: dict[str, str], verdict: T.StructType, fn: Callable[[dict[str, pa.Array]], dict[str, object]], keep: list[str] | None = None
) -> DataFrame:
    """Every row of df as the struct `row`, with the struct `verdict` that fn finds for it, batch by batch.

    inputs: name -> SQL expression over df's columns. The rows travel through Arrow untouched, so
    extra columns of any name and type are kept; keep names the columns that are wanted, if not all are.
    """
    columns = df.columns if keep is None else keep
    schema = T.StructType([T.StructField("row", df.select(*[f"`{c}`" for c in columns]).schema, False), T.StructField("verdict", verdict, False)])
    arrow = [pa.field(f.name, to_arrow(f.dataType)) for f in verdict]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            found = fn({k: b.column(i + 1) for i, k in enumerate(inputs)})
            cols = [x if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(cols, fields=arrow)], ["row", "verdict"])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *[F.expr(x).alias(f"__{k}") for k, x in inputs.items()])
    return packed.mapInArrow(run, schema)


def to_arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(to_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in t])
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}[t.simpleString()]


def by_group(df: DataFrame, key: str, ident: str) -> DataFrame:
    """df with the columns `part`, `block` and `diag`, so that rows that share (key, part) are at most about two blocks.

    A pair of rows belongs to one part: that with diag if both have one block, else that in which their blocks differ.
    A key with more than BLOCK_ROWS rows is cut into b blocks by a hash of ident, and each row goes to the
    b groups of block pairs that hold its block: every pair of rows of the key still meets in one group
    or more. Hot keys are found from the 1/32 of identities whose hash is divisible by 32; a miss costs time, not results.
    """
    sample = df.where(F.pmod(F.xxhash64(F.lit(5), F.col(ident)), F.lit(32)) == 0)
    hot = sample.groupBy(key).agg((F.count("*") * 32).alias("n")).where(F.col("n") > BLOCK_ROWS)
    hot = hot.select(key, F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit(11), F.col(ident)), F.col("blocks"))
    other = F.col("other")
    dealt = df.join(hot, key, "left").withColumn(
        "other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    part = F.when(other.isNull(), F.lit(0).cast("long")).otherwise(F.least(mine, other) * F.col("blocks") + F.greatest(mine, other))
    added = {"part": part, "block": F.coalesce(mine, F.lit(0).cast("long")), "diag": F.coalesce(mine == other, F.lit(True))}
    return dealt.withColumns(added).drop("blocks", "other")


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys: tables of whole groups of two or more rows, with the offsets of the groups."""
    rest: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> tuple[np.ndarray, int]:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        return starts, int(starts[-1])

    def whole(t: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray] | None:
        sizes = np.diff(np.append(starts, t.num_rows))
        big = sizes >= 2
        if not big.any():
            return None
        t = t.filter(pa.array(np.repeat(big, sizes)))
        return t, np.concatenate([[0], np.cumsum(sizes[big])])

    for b in batches:
        rest.append(b)
        t = pa.Table.from_batches(rest)
        if t.num_rows < 2:
            continue
        starts, last = cut(t)
        if last == 0:  # one group so far
            continue
        if found := whole(t.slice(0, last), starts[:-1]):
            yield found
        rest = t.slice(last).to_batches()
    if rest:
        t = pa.Table.from_batches(rest)
        if t.num_rows >= 2:
            starts, _ = cut(t)
            if found := whole(t, starts):
                yield found


#: Bits of a sieve: 2 MB, whatever the number of keys.
SIEVE_BITS = 24


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """One row: the array `sieve` of the bits of all keys (long hashes), modulo 2^SIEVE_BITS."""
    h = F.pmod(key, F.lit(1 << SIEVE_BITS))
    bits = keys.select(F.shiftright(h, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))").alias("bits"))
    every = keys.sparkSession.range(1 << (SIEVE_BITS - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("__sieve"))


def sifted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df cut in two by a sieve of keys: rows whose key may be among them, and rows whose key surely isn't.

    Wide rows that need no join are thus never shuffled; what passes falsely only costs its own shuffle.
    """
    bit = F.expr(f"shiftright(get(__sieve, cast(shiftright(pmod(`{key}`, {1 << SIEVE_BITS}), 6) as int)), cast(pmod(`{key}`, 64) as int)) & 1L")
    # existence joins with the one row: its array is looked into, and never copied beside a row
    return tuple(df.join(F.broadcast(sieve(keys, key)), bit == 1, how) for how in ("left_semi", "left_anti"))


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with this square boolean matrix, as stars: (centre, member) by index."""
    n = len(linked)
    seen = np.zeros(n, bool)
    centres, members = [], []
    for i in np.flatnonzero(linked.any(1)):
        if seen[i]:
            continue
        seen[i] = True
        front, own = np.array([i]), []
        while len(front):
            new = linked[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
            own.append(front)
        found = np.concatenate(own)
        centres.append(np.full(len(found), i))
        members.append(found)
    if not centres:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(centres), np.concatenate(members)


def components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of a list of links between bigint nodes: (node, component), component = the smallest node.

    Nodes without links do not appear. Each round every node picks the neighbour (or itself) with the
    smallest hash, chains of picks are shortened once, and the links are contracted to the picked
    nodes; the links left shrink by a constant factor a round in expectation, whatever the shape of the graph.
    Every row is spread by key with map-side minima, and each round is written to the shared folder.
    """
    links = ws.save(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"{name}-links-0")
    maps: list[DataFrame] = []
    k = 0
    while not links.isEmpty():
        both = links.union(links.select(F.col("b"), F.col("a")))
        rank = F.struct(F.xxhash64(F.lit(k), F.col("b")).alias("h"), F.col("b").alias("v"))
        least = both.groupBy("a").agg(F.min(rank).alias("m"))
        own = F.struct(F.xxhash64(F.lit(k), F.col("a")).alias("h"), F.col("a").alias("v"))
        pick = ws.save(least.select(F.col("a").alias("node"), F.least(F.col("m"), own)["v"].alias("to")), f"{name}-pick-{k}")
        jump = pick.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = ws.save(pick.join(jump, "to").select("node", F.col("far").alias("to")), f"{name}-step-{k}")
        maps.append(step)
        x, y = step.select(F.col("node").alias("a"), F.col("to").alias("a2")), step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        left = links.join(x, "a").join(y, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        links = ws.save(left.where("a <> b").distinct(), f"{name}-links-{k + 1}")
        ws.drop(f"{name}-links-{k}")
        ws.drop(f"{name}-pick-{k}")
        k += 1
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0]
    for step in maps[1:]:
        found = found.join(step.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    found = ws.save(found, f"{name}-roots")
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(least, "to").select("node", "component")
