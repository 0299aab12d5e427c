"""Lookups of documents and chunks in batches of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelark.functions.paths import ancestors

MAX_LINES = 200
#: Prefixes of a batch that may be broadcast.
MAX_PREFIXES = 10_000


def by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose key is in a table of keys, each once."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def resolve(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for a batch of keys; keys that are not found are left out."""
    return keys.select(key).distinct().join(table.select(key, value), key)


def docs_by_prefix(prefixes: DataFrame, docs: DataFrame) -> DataFrame:
    """(prefix, doc_slug): slugs that equal a prefix, start with it and a dot, or contain it. Prefixes are a broadcast batch."""
    some = prefixes.select("prefix").where("prefix <> ''")
    return docs.select("doc_slug").join(F.broadcast(some) if some.count() <= MAX_PREFIXES else some, F.contains("doc_slug", "prefix"))


def doc_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, those without included."""
    n = chunks.groupBy("doc_slug").agg(F.count("*").alias("n"))
    return docs.select("doc_slug", "title").join(n, "doc_slug", "left").select("doc_slug", "title", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def manifest(docs: DataFrame) -> DataFrame:
    """(slug, line): the rows of a Markdown table of slugs and titles; sorted by slug they are the catalogue."""
    clean = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\n|]", " ")
    return docs.select("doc_slug", F.concat(F.lit("| "), "doc_slug", F.lit(" | "), clean, F.lit(" |")).alias("line"))


def raw_slices(requests: DataFrame, docs: DataFrame, chunks: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """Requests (request_id, key, start_line, end_line) -> lines of a document, or an error.

    The key is a slug, else a chunk path, else a path whose longest prefix is a slug. An open end is start + max_lines - 1; wider requests are cut
    to that. Errors: NOT_FOUND, INVERTED_RANGE, OUT_OF_RANGE.
    """
    slug = docs.select(F.col("doc_slug").alias("key"), "doc_slug")
    path = chunks.select(F.col("path").alias("key"), "doc_slug").distinct()
    prefixes = requests.select("request_id", F.explode(ancestors(F.col("key"))).alias("p"))
    under = prefixes.join(slug, prefixes["p"] == slug["key"]).groupBy("request_id").agg(F.max_by("doc_slug", F.length("doc_slug")).alias("s3"))
    found = requests.join(slug.withColumnRenamed("doc_slug", "s1"), "key", "left").join(path.withColumnRenamed("doc_slug", "s2"), "key", "left").join(under, "request_id", "left")
    found = found.withColumn("doc_slug", F.coalesce("s1", "s2", "s3")).join(docs.select("doc_slug", F.split("raw_text", "\n").alias("lines")), "doc_slug", "left")
    start, total = F.coalesce("start_line", F.lit(1)), F.size("lines")
    end = F.least(F.coalesce(F.col("end_line"), total), start + max_lines - 1, total)
    error = (
        F.when(F.col("lines").isNull(), "NOT_FOUND")
        .when(F.col("end_line") < start, "INVERTED_RANGE")
        .when((start < 1) | (start > total), "OUT_OF_RANGE")
    )
    text = F.when(error.isNull(), F.array_join(F.slice("lines", F.greatest(start, F.lit(1)).cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int")), "\n"))
    return found.select("request_id", "doc_slug", F.when(error.isNull(), start).cast("long").alias("first_line"), F.when(error.isNull(), end).cast("long").alias("last_line"), text.alias("text"), error.alias("error"))


def latest(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that with the greatest order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return table.withColumn("__n", n).where("__n = 1").drop("__n")
