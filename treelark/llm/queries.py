"""The registered queries of the training-data operators, thin over the operators, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelark.llm import chat_format, embedding_dedup, html_extract, language_id, line_dedup, mixing, quality_rules, resampling, secret_scan, sentencepiece_bpe, simhash, token_shards, vector_codes
from treelark.llm.common import Workspace, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.quality(docs, read(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("row.doc_id", "verdict.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fps = ws.save(simhash.with_fingerprints(docs, keep=["doc_id"]).select("row.doc_id", "verdict.fp"), "fingerprints")
    found = simhash.near_duplicates(ws, fps)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(Workspace(spark), read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.encode_documents(docs, digests=True, keep=["doc_id"]).select("row.doc_id", "verdict.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup(Workspace(spark), docs)
    deleted = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("row.doc_id", "n_lines", deleted.alias("n_deleted"), F.sha2("text", 256).alias("text_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = mixing.copies(Workspace(spark), docs)
    return found.select("row.doc_id", "row.source", "n_tokens", F.round("weight", 6).alias("weight"), "copies")


SAID = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = json.dumps({"messages": [{"role": "user", "content": SAID}, {"role": "assistant", "content": SAID}]})
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    turns = chat_format.turns_from_rows(rows).unionByName(chat_format.turns_from_json(one))
    return chat_format.read_back(chat_format.format_turns(turns))


#: Bytes of an id: the model has 32k pieces.
ID_BYTES = 2


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids with begin and end ids, two bytes an id, packed into sequences in training order."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece_bpe.encode_ids(docs, ID_BYTES, keep=["doc_id"]).select("row.doc_id", "verdict.ids")
    shards = token_shards.materialise(Workspace(spark), ids, "ids", ID_BYTES, parts=token_shards.parts_of(docs.count()))
    return token_shards.with_digests(shards, ID_BYTES)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, keep=["doc_id"]).select("row.doc_id", "verdict.*")
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(Workspace(spark), read(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(Workspace(spark), docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, keep=["doc_id"]).select("row.doc_id", "verdict.*")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    coded, books = vector_codes.compress(ws, read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    found = vector_codes.with_label_errors(ws, coded)
    return found.select("row.vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_token_shards": op8_token_shards,
    "op9_language_id": op9_language_id,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_secret_scan": op12_secret_scan,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op5_line_dedup": line_dedup.oracle(),
    "op7_chat_formatting": chat_format.oracle(SAID),
    "op10_embedding_near_dedup": embedding_dedup.oracle(),
    "op11_importance_resampling": resampling.oracle(),
    "op13_vector_codes": vector_codes.oracle(),
}
