"""Checks of cited answers in batches: normalisation, staged validation, resolution and renumbering of markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelark.functions.paths import is_valid_path
from treelark.functions.text import contains_quote
from treelark.operators.navigate import leaf_rows

MARKER = r"\[#(\d+)\]"


def normalise_citations(citations: Column) -> Column:
    """Array of (path, citation_text): trimmed, those without a path dropped, blank quotes null."""
    trimmed = F.transform(citations, lambda c: F.struct(F.trim(c["path"]).alias("path"), F.nullif(F.trim(c["citation_text"]), F.lit("")).alias("citation_text")))
    return F.filter(trimmed, lambda c: F.coalesce(c["path"] != "", F.lit(False)))


def cited(answers: DataFrame) -> DataFrame:
    """(answer_id, i, path, citation_text): the citations of answers that are not abstained, numbered from 1."""
    c = answers.where("not abstained").select("answer_id", F.posexplode(normalise_citations(F.col("citations"))).alias("i", "c"))
    return c.select("answer_id", (F.col("i") + 1).alias("i"), "c.path", "c.citation_text")


def violations(answers: DataFrame, chunks: DataFrame, extra: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(answer_id, code, path): first the syntax of an answer, and only if that holds the citations against the chunks.

    Codes: EMPTY_ANSWER, MISSING_CITATIONS, INVALID_LTREE_PATH, DANGLING_CITATION_MARKER; then PATH_NOT_FOUND, MISSING_CITATION_TEXT,
    UNGROUNDED_CITATION_TEXT. Abstained answers are only checked for emptiness. extra: functions from answers to further rows.
    """
    none = F.lit(None).cast("string").alias("path")
    a = answers.withColumn("n", F.size(normalise_citations(F.col("citations"))))
    empty = a.where(F.coalesce(F.trim("answer") == "", F.lit(True))).select("answer_id", F.lit("EMPTY_ANSWER").alias("code"), none)
    missing = a.where("not abstained and n = 0").select("answer_id", F.lit("MISSING_CITATIONS").alias("code"), none)
    c = cited(answers)
    invalid = c.where(~is_valid_path(F.col("path"))).select("answer_id", F.lit("INVALID_LTREE_PATH").alias("code"), "path")
    marks = a.where("not abstained and n > 0").select("answer_id", "n", F.explode(F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1))).alias("m"))
    outside = F.coalesce((F.expr("try_cast(m as int)") < 1) | (F.expr("try_cast(m as int)") > F.col("n")), F.lit(True))
    dangling = marks.where(outside).select("answer_id", F.lit("DANGLING_CITATION_MARKER").alias("code"), F.concat(F.lit("[#"), "m", F.lit("]")).alias("path")).distinct()
    syntax = empty.unionByName(missing).unionByName(invalid).unionByName(dangling)
    good = c.join(syntax.select("answer_id").distinct(), "answer_id", "left_anti")
    looked = resolved(good, chunks)
    code = F.when(F.col("leaf").isNull(), "PATH_NOT_FOUND").when(F.col("citation_text").isNull(), "MISSING_CITATION_TEXT").when(~F.col("grounded"), "UNGROUNDED_CITATION_TEXT")
    found = looked.select("answer_id", code.alias("code"), "path").where("code is not null")
    out = syntax.unionByName(found)
    for rule in extra or []:
        out = out.unionByName(rule(answers))
    return out


def resolved(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations with the leaf that answers each: the first under its path that holds the quote, else the first; null if none.

    Leaves get their texts before they meet the citations, so a quote isn't copied for every leaf before it is moved, and what meets by path is summed up there.
    """
    leaves = leaf_rows(citations.select(F.col("path").alias("query_path")), chunks).withColumnRenamed("query_path", "path")
    text = chunks.select(F.col("path").alias("leaf"), "doc_slug", "verbatim_text")
    wide = citations.select("answer_id", "i", "path", "citation_text").join(leaves.join(text, "leaf"), "path", "left")
    wide = wide.withColumn("grounded", contains_quote(F.col("verbatim_text"), F.col("citation_text")))
    best = F.min_by(F.struct("leaf", "doc_slug", "verbatim_text", "grounded"), F.struct(~F.col("grounded"), F.col("leaf")))
    return wide.groupBy("answer_id", "i", "path", "citation_text").agg(best.alias("b")).select("answer_id", "i", "path", "citation_text", "b.*")


def numbered(looked: DataFrame) -> DataFrame:
    """(answer_id, i, leaf, k): citations of one chunk share the number k, counted by first use."""
    first = looked.where("leaf is not null").withColumn("first", F.min("i").over(Window.partitionBy("answer_id", "leaf")))
    return first.withColumn("k", F.dense_rank().over(Window.partitionBy("answer_id").orderBy("first"))).select("answer_id", "i", "leaf", "doc_slug", "k")


def renumber(answers: DataFrame, numbers: DataFrame) -> DataFrame:
    """(answer_id, answer): markers rewritten to the new numbers, unmapped ones dropped; all numbers appended if no marker remains."""
    by = numbers.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("string"), F.col("k").cast("string")))).alias("m"), F.max("k").alias("top"))
    a = answers.join(by, "answer_id", "left")
    marks, texts = F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1)), F.split("answer", MARKER.replace("(", "").replace(")", ""), -1)
    new = F.transform(marks, lambda x: F.coalesce(F.concat(F.lit("[#"), F.try_element_at("m", x), F.lit("]")), F.lit("")))
    whole = F.aggregate(F.zip_with(texts, new, lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), F.lit(""), lambda s, x: F.concat(s, x))
    a = a.withColumn("text", F.trim(whole))
    tail = F.array_join(F.transform(F.sequence(F.lit(1), F.col("top")), lambda k: F.concat(F.lit("[#"), k.cast("string"), F.lit("]"))), "")
    lacks = F.col("top").isNotNull() & ~F.col("text").rlike(MARKER)
    return a.select("answer_id", F.when(lacks, F.concat("text", F.lit(" "), tail)).otherwise(F.col("text")).alias("answer"))
