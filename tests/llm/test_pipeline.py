"""The pipeline on a small corpus: every stage's decisions take effect, and copies and later passages go."""

import random

import pytest

import corpus_pipeline
from treelark.llm import queries


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    passage = words(70, 999)
    rows = [(i, words(80, i) + "\n" + (passage + "\n" if i in (3, 7) else "") + words(40, 1000 + i), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(40, rows[5][1], "en", "s0", 0), (41, None, "en", None, 0), (42, "too short", "en", "s1", 0), (43, "b b " * 60, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d, passage


def test_stages(spark, folder):
    d, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    assert {r["doc_id"] for r in seen["quality_rules"]} == set(range(41))
    lines = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert set(lines) == set(range(40))
    assert passage in lines[3]["text"] and passage not in lines[7]["text"]
    assert lines[7]["n_chars"] == len(lines[7]["text"])
    assert {r["doc_id"] for r in seen["simhash_near_dedup"]} == set(range(40))
    assert {r["doc_id"] for r in seen["mixing"]} == set(range(40))
    assert len(seen["sentencepiece"]) == len(seen["mixing"])


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder[0])
    assert found.select("doc_id").distinct().count() == 40
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
