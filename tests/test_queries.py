"""Every registered query of the engine against its DuckDB SQL over the smallest tables."""

import duckdb
import pytest

from treelark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = db.sql(catalogue.ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_corpus_files_of_odd_lines_and_sources(spark, db, tmp_path):
    rows = [("a", "# head\n\nx"), ("b", "\n"), ("b", "c\r\n\r"), ("c/d %2F", "\x00\n\x01"), ("", "x"), (None, "y"), ("e", None)]
    spark.createDataFrame([(k, s, t, "en") for k, (s, t) in enumerate(rows)], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["src_corpus_files"](spark, str(tmp_path)).collect()
    want = db.sql(f"WITH documents AS (SELECT * FROM '{tmp_path}/documents.parquet/*.parquet') {catalogue.ORACLE['src_corpus_files']}").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
