"""Sources and sinks: files, inline documents, evaluation cases, benchmark payloads and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelark.functions.paths import canonical_path

SUFFIXES = ("md", "mdx", "markdown", "mdown")
SNAPSHOT = ("documents", "chunks", "graph_edges")
CASE_SCHEMA = "id string, test_set string, domain string, question string, query string, pattern string, is_regex boolean, case_sensitive boolean, doc_slugs array<string>, path_prefix string, note string, expected array<struct<doc_slug: string, path: string, path_suffix: string>>"


def corpus_files(spark: SparkSession, root: str, namespace: str = "") -> DataFrame:
    """(file, doc_slug, raw_text) of the Markdown files under a folder; hidden files and folders are passed over."""
    pattern = "*.{" + ",".join(SUFFIXES) + "}"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = rows.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("raw_text"))
    base = F.regexp_replace(F.lit(root), "/+$", "")
    rest = F.regexp_replace(F.regexp_replace("file", "^file:/*", "/"), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(base, "^file:/*", "/"), r"([.+*?^$()\[\]{}|\\])", r"\\$1")), F.lit(""))
    return rows.where(~rest.rlike(r"/\.")).select("file", slug_of(F.col("file"), root, namespace).alias("doc_slug"), "raw_text")


def write_files(lines: DataFrame, root: str, by: str, lines_a_file: int = 5000) -> None:
    """Lines (by, line) as Markdown files, each line as it is, in a folder for each value of `by` (`folder_value` reads it back from the path)."""
    name = F.concat(F.lit("x"), F.hex(F.encode(by, "UTF-8"))).alias(by)
    lines.select(name, "line").write.partitionBy(by).option("maxRecordsPerFile", str(lines_a_file)).text(root)
    spark = lines.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "*/part-*.txt")) or []:  # Spark names files itself
        path = part.getPath()
        if not fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), path.getName().removesuffix("txt") + "md")):
            raise OSError(f"{path} can't be renamed")


def folder_value(file: Column, by: str) -> Column:
    """The value of `by` of a file written by write_files; null for the folder of nulls."""
    return F.decode(F.unhex(F.nullif(F.regexp_extract(file, f"/{by}=(x[0-9A-F]*)/", 1), F.lit("")).substr(2, 1 << 30)), "UTF-8")


def slug_of(file: Column, root: str, namespace: str = "") -> Column:
    """The path of a file below the root as a slug, with the namespace in front unless it is there."""
    clean = F.regexp_replace(file, "^file:/*", "/")
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    rest = F.regexp_replace(F.when(clean.startswith(base), F.substr(clean, F.lit(len(base) + 1))).otherwise(clean), r"\.(md|mdx|markdown|mdown)$", "")
    slug = canonical_path(rest)
    if not namespace:
        return slug
    return F.when((slug == namespace) | slug.startswith(namespace + "."), slug).otherwise(F.concat(F.lit(namespace + "."), slug))


def profile_of(file: Column, text: Column) -> Column:
    """The profile of a document by a part of its path or a mark in its text; null if none fits."""
    part = F.lower(file)
    return (
        F.when(part.rlike(r"(^|/)nextjs(/|$)") | text.rlike(r"<(AppOnly|PagesOnly)>"), "nextjs")
        .when(part.rlike(r"(^|/)nodejs(/|$)") | text.rlike(r"<!--\s*introduced_in="), "nodejs")
        .when(part.rlike(r"(^|/)(legal|luat)(/|$)") | text.rlike(r"(?m)^#{1,6}\s+(Chương|Điều)\s+[0-9IVXLC]+"), "legal")
    )


def dispatch(docs: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with their profile, those that no profile fits). strict: a document without a profile fails the job."""
    marked = docs.withColumn("profile", profile_of(F.col("file"), F.col("raw_text")))
    if strict:
        marked = marked.withColumn("profile", F.when(F.col("profile").isNull(), F.raise_error(F.concat(F.lit("no profile for "), "file"))).otherwise(F.col("profile")))
    return marked.where("profile is not null"), marked.where("profile is null")


def inline_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of rows (doc_slug, title, text or bytes, suffix); bytes without a suffix are rejected."""
    text = rows.withColumn("raw_text", F.col("text").cast("string"))
    bad = F.coalesce(F.trim("suffix") == "", F.lit(True)) & F.lit(dict(rows.dtypes)["text"] == "binary")
    return text.where(~bad).select("doc_slug", "title", "raw_text", "suffix"), text.where(bad).select("doc_slug", F.lit("MISSING_SUFFIX").alias("error"))


def seed(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """existing with those rows whose key is absent."""
    return existing.unionByName(rows.join(existing.select(key), key, "left_anti"))


def read_cases(spark: SparkSession, *paths: str) -> DataFrame:
    """Evaluation cases of JSON Lines files, or of files with one JSON array, with their expected targets normalised."""
    parts = []
    for path in paths:
        parts.append(spark.read.schema(CASE_SCHEMA).option("multiLine", not path.endswith("jsonl")).json(path))
    return normalise_expected(reduce(DataFrame.unionByName, parts))


def normalise_expected(cases: DataFrame) -> DataFrame:
    """expected as (doc_slug, path_suffix): a path string is cut at the longest slug in scope, else after three labels for nextjs, else two."""
    fields = cases.schema["expected"].dataType.elementType.names
    slugs = F.coalesce(F.col("doc_slugs"), F.array().cast("array<string>"))

    def one(e: Column) -> Column:
        given = e["doc_slug"]
        path = e["path"] if "path" in fields else F.lit(None).cast("string")
        fits = F.filter(slugs, lambda s: (path == s) | path.startswith(F.concat(s, F.lit("."))))
        longest = F.get(F.reverse(F.array_sort(F.transform(fits, lambda s: F.struct(F.length(s).alias("l"), s.alias("s"))))), F.lit(0))["s"]
        parts = F.split(path, r"\.")
        cut = F.array_join(F.slice(parts, F.lit(1), F.when(F.get(parts, F.lit(0)) == "nextjs", 3).otherwise(2)), ".")
        slug = F.coalesce(given, longest, cut)
        rest = F.when(path.startswith(F.concat(slug, F.lit("."))), F.substr(path, F.length(slug) + 2)).otherwise("")
        suffix = F.coalesce(e["path_suffix"], rest) if "path_suffix" in fields else F.coalesce(rest, F.lit(""))
        return F.struct(slug.alias("doc_slug"), F.coalesce(suffix, F.lit("")).alias("path_suffix"))

    return cases.withColumn("expected", F.transform("expected", one))


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases as JSON Lines, split by test set into folders."""
    cases.write.mode("overwrite").partitionBy("test_set").json(path)


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark payloads of JSON arrays, one file a batch; the batch is the digits of the file's name."""
    rows = spark.read.option("multiLine", True).json(folder)
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1))


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    for name in SNAPSHOT:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in SNAPSHOT}


def restore_snapshot(spark: SparkSession, folder: str, store: str, clean: bool = True) -> None:
    """A snapshot into a store of parquet tables: in place of what is there, or behind it."""
    for name, df in read_snapshot(spark, folder).items():
        df.write.mode("overwrite" if clean else "append").parquet(f"{store}/{name}")
