"""Merges of documents, chunks and edges as joins, the embedding of texts, and the job that takes documents into a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelark.operators.validate import chunk_violations
from treelark.sources.scratch import exists, freed, saved, step

KEEP_ON_UPDATE = ("id", "created_at")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = KEEP_ON_UPDATE, prefer_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: new rows replace old ones, except for the columns `keep`, and for `prefer_old_if_null` where the new value is null."""
    o = old.select(key, *[F.col(c).alias(f"__o_{c}") for c in old.columns if c != key], F.lit(True).alias("__old"))
    n = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in old.columns if c != key], F.lit(True).alias("__new"))

    def pick(c: str) -> Column:
        was, now = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if c in keep:
            return F.coalesce(was, now).alias(c)
        return (F.coalesce(now, was) if c in prefer_old_if_null else F.when(F.col("__new"), now).otherwise(was)).alias(c)

    return o.join(n, key, "full_outer").select(*[F.col(c) if c == key else pick(c) for c in old.columns])


def split_by_reuse(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new chunks (path, contextualized_text) with the stored vector where path and text are unchanged, and needs_embedding."""
    s = stored.where("embedding is not null").select("path", F.xxhash64("contextualized_text").alias("__h"), F.col("contextualized_text").alias("__t"), "embedding")
    joined = new.drop("embedding").withColumn("__h", F.xxhash64("contextualized_text")).join(s, ["path", "__h"], "left")
    vector = F.when(F.col("__t") == F.col("contextualized_text"), F.col("embedding"))
    return joined.withColumn("embedding", vector).drop("__h", "__t").withColumn("needs_embedding", F.col("embedding").isNull())


def delete_stale(stored: DataFrame, produced: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, edges) without the chunks of re-ingested documents that are no longer produced, and without their edges."""
    again = stored.join(produced.select("doc_slug").distinct(), "doc_slug", "left_semi")
    stale = again.join(produced.select("path"), "path", "left_anti").select("path")
    left = edges.join(stale.withColumnRenamed("path", "source"), "source", "left_anti").join(stale.withColumnRenamed("path", "target"), "target", "left_anti")
    return stored.join(stale, "path", "left_anti"), left


def skip_existing(incoming: DataFrame, stored: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to ingest, skipped with their stored chunk counts)."""
    n = chunks.groupBy("doc_slug").agg(F.count("*").alias("n"))
    there = stored.select("doc_slug")
    skipped = incoming.select("doc_slug").join(there, "doc_slug", "left_semi").join(n, "doc_slug", "left").select("doc_slug", F.coalesce("n", F.lit(0)).alias("stored_chunks"))
    return incoming.join(there, "doc_slug", "left_anti"), skipped


def resolve_edges(drafts: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Draft edges (source_path, target_path, ...) with ids from the batch's chunks, else from the store; unresolved and self edges go."""
    ids = batch.select("path", "id", F.lit(0).alias("pri")).unionByName(stored.select("path", "id", F.lit(1).alias("pri")))
    ids = ids.groupBy("path").agg(F.min_by("id", "pri").alias("id"))
    s, t = ids.select(F.col("path").alias("source_path"), F.col("id").alias("source")), ids.select(F.col("path").alias("target_path"), F.col("id").alias("target"))
    return drafts.join(s, "source_path").join(t, "target_path").where("source <> target")


def upsert_edges(edges: DataFrame, incoming: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after the upsert, rejected rows of unknown relations). incoming has seq; of duplicates the last with a rationale counts, else the first."""
    codes = F.broadcast(relations.select(F.col("code").alias("relation_type")))
    ok, bad = incoming.join(codes, "relation_type", "left_semi"), incoming.join(codes, "relation_type", "left_anti")
    key = ["source", "target", "relation_type"]
    has = F.col("rationale").isNotNull()
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(has), F.when(has, -F.col("seq")).otherwise(F.col("seq"))))
    one = ok.withColumn("__n", n).where("__n = 1").select(*key, "citation_text", "rationale")
    o = edges.select(*key, F.col("citation_text").alias("oc"), F.col("rationale").alias("orat"), F.lit(True).alias("there"))
    joined = o.join(one, key, "full_outer")
    return joined.select(*key, F.coalesce("citation_text", "oc").alias("citation_text"), F.coalesce("rationale", "orat").alias("rationale")), bad


def summary(docs: DataFrame, chunks: DataFrame, edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: how many documents, chunks and edges, and how many documents were passed over."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(docs, "documents").join(count(chunks, "chunks")).join(count(edges, "edges")).join(count(skipped, "skipped"))


def unembedded(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks without a vector, oldest first."""
    rows = chunks.where("embedding is null").orderBy("created_at", "path")
    return rows if limit is None else rows.limit(limit)


def normalise(vector: Column, dims: int | None = None) -> Column:
    """The first dims components, scaled to unit length in double precision; a zero vector stays zero."""
    v = F.transform(vector if dims is None else F.slice(vector, 1, dims), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x))


# Prefixes that families of encoders expect in front of a text.
PREFIXES = {"e5": ("query: ", "passage: "), "instruct": ("Instruct: retrieve passages that answer the query\nQuery: ", ""), "plain": ("", "")}


def prefixed(text: Column, family: str = "plain", is_query: bool = False) -> Column:
    lead = PREFIXES[family][0 if is_query else 1]
    return F.when(text.startswith(lead), text).otherwise(F.concat(F.lit(lead), text)) if lead else text


def hashing_encoder(dims: int) -> Callable[[list[str]], np.ndarray]:
    """Feature hashing of words into dims signed buckets: the default encoder where no model is installed."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1.0 if h & (1 << 31) else -1.0
        return out

    return encode


def embed(texts: DataFrame, text: str = "contextualized_text", dims: int = 64, make_encoder: Callable[[int], Callable[[list[str]], np.ndarray]] = hashing_encoder, batch_size: int = 256, family: str = "plain", is_query: bool = False) -> DataFrame:
    """texts with an L2-normalised vector `embedding`. The encoder is made once a task and given batch_size texts at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder(dims)
        for s in batches:
            out = []
            for k in range(0, len(s), batch_size):
                v = np.asarray(encode(s.iloc[k : k + batch_size].tolist()), np.float64)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                out += list((v / np.where(length > 0, length, 1)).astype(np.float32))
            yield pd.Series(out)

    return texts.withColumn("embedding", run(prefixed(F.col(text), family, is_query)))


def with_namespace(slug: Column, namespace: str) -> Column:
    return F.when(slug.startswith(namespace + "."), slug).otherwise(F.concat(F.lit(namespace + "."), slug))


def backfill_citations(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with missing or blank citation_text filled from the source's own text."""
    t = chunks.select(F.col("path").alias("source"), F.col("verbatim_text").alias("__t"))
    return edges.join(t, "source", "left").withColumn("citation_text", F.coalesce(F.nullif(F.trim("citation_text"), F.lit("")), "__t")).drop("__t")


# The tables of a store. Rows lie in buckets of their doc_slug; an edge's is that of its source.
STORE = {
    "documents": "doc_slug string, id string, file string, raw_text string, profile string",
    "chunks": "path string, id string, doc_slug string, verbatim_text string, contextualized_text string, start_line bigint, end_line bigint, node_type string, profile string, embedding array<float>",
    "edges": "doc_slug string, source string, target string, relation_type string, citation_text string, rationale string",
    "quarantine": "doc_slug string, path string, reason string",
}
EDGE = ["source", "target", "relation_type", "citation_text", "rationale"]
#: Buckets of a new store.
BUCKETS = 64


def bucket_of(slug: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(slug)), F.lit(buckets)).cast("int")


class Store:
    """A store of tables in hash buckets. A version is a small list (table, bucket, place) of where each bucket lies: it takes over the buckets of the
    version before, but for those that were written for it. The list is written last, so a version is there wholly or not at all, and a
    version that was cut short is simply written again."""

    def __init__(self, spark: SparkSession, root: str, version: int, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.version = spark, root, version
        self.places: dict[str, dict[int, str]] = {name: {} for name in STORE}
        self.buckets = buckets
        if version:
            for r in spark.read.schema("table string, bucket int, place string").json(f"{root}/versions/v{version}").collect():  # tables x buckets rows
                if r["table"] == "":
                    self.buckets = r["bucket"]
                else:
                    self.places[r["table"]][r["bucket"]] = r["place"]

    def table(self, name: str, some: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it: no others are read."""
        paths = [place for k, place in sorted(self.places[name].items()) if some is None or k in some]
        return self.spark.read.schema(STORE[name]).parquet(*paths) if paths else self.spark.createDataFrame([], STORE[name])

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(bucket_of("doc_slug", self.buckets)).distinct().collect())

    def is_there(self, version: int) -> bool:
        return exists(self.spark, f"{self.root}/versions/v{version}/_SUCCESS")

    def write(self, name: str, rows: DataFrame, some: list[int]) -> None:
        """The new rows of some buckets; a bucket without any is gone."""
        columns = [f.split(" ")[0] for f in STORE[name].split(", ")]
        at = f"{self.root}/data/v{self.version + 1}/{name}"
        placed = rows.select(*columns, bucket_of("doc_slug", self.buckets).alias("bucket"))
        with freed(self.spark):
            placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        for k in some:
            self.places[name].pop(k, None)
            if exists(self.spark, f"{at}/bucket={k}"):
                self.places[name][k] = f"{at}/bucket={k}"

    def commit(self) -> Store:
        rows = [(name, k, place) for name, own in self.places.items() for k, place in own.items()] + [("", self.buckets, "")]
        self.spark.createDataFrame(rows, "table string, bucket int, place string").coalesce(1).write.mode("overwrite").json(f"{self.root}/versions/v{self.version + 1}")
        return Store(self.spark, self.root, self.version + 1)


def read_store(spark: SparkSession, store: str, version: int) -> dict[str, DataFrame]:
    """The tables of a version of a store; version 0 is empty."""
    own = Store(spark, store, version)
    return {name: own.table(name) for name in STORE}


def ingest_documents(docs: DataFrame, *args, **options) -> DataFrame:
    """`ingested`, whose scratch tables go when the version is written."""
    with step(docs.sparkSession):
        return saved(ingested(docs, *args, **options), "ingest-summary", keep=True)


def ingested(docs: DataFrame, profiles, store: str, version: int, drafts: DataFrame | None = None, relations: DataFrame | None = None, overwrite: bool = True, strict: bool = False, dims: int = 64, buckets: int = BUCKETS) -> DataFrame:
    """Takes documents (file, doc_slug, raw_text) into version + 1 of a store and returns its summary (documents, chunks, edges, embedded, skipped, quarantined).

    Each document is cut by its profile and its chunks are checked; documents without a profile or with a broken rule go to the quarantine with
    their reasons, or fail the job if strict. Documents that are stored already are passed over unless overwrite. Vectors of unchanged chunks are kept, others
    are made; chunks that a document no longer has go, with their edges. drafts: edges (source_path, target_path, relation_type, citation_text,
    rationale, seq) by paths. Only the buckets that hold a document of the batch, or an edge that comes or goes, are written, beside the old ones:
    a job that fails leaves the store as it was and can be run again.
    """
    spark = docs.sparkSession
    old = Store(spark, store, version, buckets)
    if old.is_there(version + 1):
        raise ValueError(f"{store} has a version {version + 1}")
    some = old.touched(docs)
    there, stored = old.table("documents", some), old.table("chunks", some)
    docs, skipped = (docs, docs.limit(0).select("doc_slug")) if overwrite else skip_existing(docs, there, stored)
    chunks, unknown = profiles.chunk(docs)
    chunks = saved(chunks.select("doc_slug", "path", "verbatim_text", "contextualized_text", "start_line", "end_line", "node_type", "profile"), "ingest-chunks")
    broken = chunk_violations(chunks, docs).select("doc_slug", "path", F.col("rule").alias("reason"))
    bad = saved(broken.unionByName(unknown.select("doc_slug", F.lit(None).cast("string").alias("path"), F.lit("NO_PROFILE").alias("reason"))), "ingest-quarantine")
    if strict and (first := bad.first()):
        raise ValueError(f"{first['doc_slug']}: {first['reason']}")
    sound = docs.join(bad.select("doc_slug").distinct(), "doc_slug", "left_anti")
    names = chunks.select("doc_slug", "profile").distinct()
    new_docs = sound.join(names, "doc_slug", "left").select("doc_slug", F.md5("doc_slug").alias("id"), "file", "raw_text", "profile")
    produced = chunks.join(sound.select("doc_slug"), "doc_slug", "left_semi")
    # a document that no longer has any chunk counts as produced, too
    edges = old.table("edges")
    columns = [f.split(" ")[0] for f in STORE["chunks"].split(", ")]
    if any(k in old.places["chunks"] for k in some):
        left, kept = delete_stale(stored, produced.select("doc_slug", "path").unionByName(sound.select("doc_slug", F.lit(None).cast("string").alias("path"))), edges)
        reused = saved(split_by_reuse(produced, stored), "ingest-reuse")
        fresh = embed(reused.where("needs_embedding").drop("embedding"), dims=dims)
        made = reused.where("not needs_embedding").unionByName(fresh.select(*reused.columns)).withColumn("id", F.md5("path")).select(*columns)
        known = upsert(left, made, "path", ("id",)).select(*columns)
        n_fresh = reused.where("needs_embedding")
    else:  # nothing is stored where the batch goes: all chunks are new, so their texts aren't joined with anything or written between
        kept, n_fresh = edges, produced
        known = embed(produced, dims=dims).withColumn("id", F.md5("path")).select(*columns)
    slugs = edges.select("source", "doc_slug").distinct()
    if drafts is not None and relations is not None:
        others = [k for k in old.places["chunks"] if k not in some]
        ids = known.select("path", "doc_slug")
        ids = ids.unionByName(old.table("chunks", others).select("path", "doc_slug")) if others else ids
        ids = saved(ids, "ingest-paths")
        resolved = resolve_edges(drafts, ids.select("path", F.col("path").alias("id")), ids.select("path", F.col("path").alias("id")).limit(0))
        kept, _ = upsert_edges(kept, resolved, relations)
        slugs = ids.select(F.col("path").alias("source"), "doc_slug")
    new_edges = saved(kept.select(*EDGE).join(slugs, "source"), "ingest-edges")
    changed = old.touched(edges.select("doc_slug", *EDGE).exceptAll(new_edges.select("doc_slug", *EDGE)).unionByName(new_edges.select("doc_slug", *EDGE).exceptAll(edges.select("doc_slug", *EDGE))))
    own = bucket_of("doc_slug", old.buckets)
    old.write("edges", new_edges.where(own.isin(changed)), changed)
    quarantined = old.table("quarantine", some).join(docs.select("doc_slug"), "doc_slug", "left_anti").unionByName(bad)
    old.write("quarantine", quarantined, some)
    old.write("documents", upsert(there, new_docs, "doc_slug", ("id",)), some)
    old.write("chunks", known, some)
    new = old.commit()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    more = count(n_fresh, "embedded").join(new.table("quarantine").agg(F.countDistinct("doc_slug").alias("quarantined")))
    return summary(new.table("documents"), new.table("chunks"), new.table("edges"), skipped).join(more)


def ingest_stream(stream: DataFrame, profiles, store: str, checkpoint: str, base: int = 0, **options) -> int:
    """Takes a stream of documents (file, doc_slug, raw_text) into a store, and returns the store's last version when all that has arrived is taken in.

    Batch k makes version base + k + 1 of the store. If a trigger is killed, its batch comes again: a version that is there is passed over, one that
    was cut short is written again, so each document is taken in exactly once. Of a document that stands twice in a batch, the row with the greatest text counts.
    options: those of ingest_documents.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, k: int) -> None:
        if Store(spark, store, 0).is_there(base + k + 1):
            return
        once = batch.groupBy("doc_slug").agg(F.max(F.struct("raw_text", "file")).alias("r")).select("r.file", "doc_slug", "r.raw_text")
        with step(once.sparkSession):
            ingest_documents(saved(once, "ingest-batch"), profiles, store, base + k, **options)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    version = base
    while Store(spark, store, 0).is_there(version + 1):
        version += 1
    return version
