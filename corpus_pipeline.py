"""The corpus pipeline: documents -> quality rules -> line dedup -> SimHash near-dedup -> mixing -> token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelark.llm import line_dedup, mixing, quality_rules, sentencepiece_bpe, simhash
from treelark.llm.common import Workspace, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality_rules.quality(docs, read(spark, sf_dir, "labels")).where("verdict.kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document that loses its last word this way goes."""
    found = line_dedup.dedup(Workspace(spark), docs).where("size(spans) = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("text"), "n_chars": F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col("row.n_chars")).cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.one_of_each(Workspace(spark), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix passes it, once at least."""
    return mixing.mixed(Workspace(spark), docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded text of every document."""
    return sentencepiece_bpe.encode_documents(docs, digests=True, keep=["doc_id", "source"]).select("row.*", "verdict.*")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    ws = Workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.save(docs, name)
    return docs
