"""Column functions on paths and texts, with the golden cases of FIXTURES.md part B in own words."""

import random

import pytest
from pyspark.sql import functions as F

from treelark.functions import paths as p
from treelark.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "label"), [("Đặc tả", "dac_ta"), ("cơ sở dữ liệu", "co_so_du_lieu"), ("muc_" + "a" * 300, "muc_" + "a" * 246), ("  ", None), ("!!!", None), ("A--B c", "a_b_c"), ("Čapek Žluť", "capek_zlut"), ("Ōsaka ﬁx ½", "osaka_fix_1_2"), ("a__b _c_", "a__b__c"), ("x" * 249 + "_y", "x" * 249), ("\u00a0Ⅷ \u2003", "viii"), ("ß straße", "stra_e"), ("Ǆ№", "dzno")])
def test_labels(spark, raw, label):
    assert one(spark, p.sanitise_label(F.lit(raw))) == label


def test_foreign_label(spark):
    x = one(spark, p.sanitise_label(F.lit("概要")))
    assert x.startswith("u_") and len(x) == 14


def test_paths(spark):
    assert one(spark, p.canonical_path(F.lit("Docs/Part 1\\Über.x"))) == "docs.part_1.uber.x"
    assert one(spark, p.ancestors(F.lit("a.b.c"))) == ["a", "a.b"]
    assert one(spark, p.ancestors(F.lit("a"))) == []
    assert one(spark, p.subpath(F.lit("a.b.c.d"), 1, 2)) == "b.c"
    assert one(spark, p.subpath(F.lit("a.b.c.d"), -1)) == "d"
    assert one(spark, p.parent_path(F.lit("a"))) is None
    assert not one(spark, p.is_under(F.lit("a.b10"), F.lit("a.b1")))
    assert [one(spark, p.is_valid_path(F.lit(x))) for x in ("a.b_1", "a..b", "", "a.b-", None)] == [True, False, False, False, False]


def test_natural_order(spark):
    want = ["d.chuong_i", "d.chuong_ii", "d.chuong_ix", "d.chuong_x", "d.s_2", "d.s_10"]
    mixed = want[:]
    random.Random(0).shuffle(mixed)
    long = ["a.1234567890123", "a.1234567890124", "a.999999999999", "a.007", "a.8", "a." + "9" * 40, "a.1" + "0" * 40]
    asked = spark.createDataFrame([(x,) for x in long], "path string").orderBy(p.natural_key(F.col("path"))).collect()
    assert [int(r["path"][2:]) for r in asked] == sorted(int(x[2:]) for x in long)
    rows = spark.createDataFrame([(x,) for x in mixed], "path string").orderBy(p.natural_key(F.col("path"))).collect()
    assert [r[0] for r in rows] == want


@pytest.mark.parametrize(("segment", "shown"), [("chuong_i", "Chương I"), ("dieu_15", "Điều 15"), ("tieu_muc_1", "Tiểu mục 1"), ("muc_2", "Mục 2"), ("other_x", "other_x"), ("dieu_15a", "Điều 15a"), ("khoan_3_b", "Khoản 3 b"), ("phan_ii", "Phần II"), ("phu_luc_i", "Phụ lục I")])
def test_humanise(spark, segment, shown):
    assert one(spark, p.humanise(F.lit(segment))) == shown


def test_spans(spark):
    text = "a  (b)\n c. d"
    assert tuple(one(spark, tx.find_span(F.lit(text), F.lit("(b) c. ")))) == (3, 10)
    assert one(spark, tx.find_span(F.lit(text), F.lit("zz"))) is None
    assert one(spark, tx.find_span(F.lit(text), F.lit("  "))) is None
    assert one(spark, tx.contains_quote(F.lit(text), F.lit("a (b)")))
    assert not one(spark, tx.contains_quote(F.lit(None).cast("string"), F.lit("a")))


@pytest.mark.parametrize(("context", "verbatim", "want"), [("[a > b]\nx", "x", ("a > b", "x")), ("x", "x", ("", "x")), ("", "x", ("", "x")), (None, "x", ("", "x")), ("[a]\ny", "x", ("", "[a]\ny"))])
def test_context(spark, context, verbatim, want):
    assert tuple(one(spark, tx.split_context(F.lit(context).cast("string"), F.lit(verbatim)))) == want


def test_trigrams(spark):
    assert sorted(one(spark, tx.trigrams(F.lit("Cat")))) == sorted(["  c", " ca", "cat", "at "])
    assert one(spark, tx.trigram_similarity(F.lit("cat"), F.lit("CAT"))) == 1.0
    assert one(spark, tx.word_similarity(F.lit("b c"), F.lit("a b c d"))) == 1.0
    assert one(spark, tx.word_similarity(F.lit("b"), F.lit(""))) == 0.0


def test_needed_grams_are_in_every_match():
    """Whatever a random expression matches holds all grams of one of its alternatives."""
    import random
    import re

    from treelark.functions import patterns

    rng = random.Random(6)
    words = ["foo", "Barn", "x", "quux", "ab", "the end", "1.5", "naïve"]

    def expression(depth: int) -> str:
        kind = rng.randrange(9) if depth else 0
        inner = lambda: expression(depth - 1)
        if kind <= 2:
            return re.escape(rng.choice(words))
        if kind == 3:
            return f"({inner()}|{inner()})"
        if kind == 4:
            return f"(?:{inner()}){rng.choice(['?', '*', '+', '{0,2}', '{1,2}', '+?'])}"
        if kind == 5:
            return rng.choice([".", "[a-f]+", "\\w*", "\\d", "[^]x]?", "s?", "o+", "(?=f)", "(?!z)", "\\b"])
        return inner() + inner()

    matched = looked = 0
    for _ in range(4000):
        pattern = expression(3)
        alternatives = patterns.grams_of(patterns.needs_of_regex(pattern))
        looked += bool(alternatives)
        for _ in range(4):
            hay = "".join(rng.choice([*words, " ", "o", "s", "f", "7"]) for _ in range(rng.randrange(1, 9)))
            if re.search(pattern, hay):
                matched += 1
                assert not alternatives or any(all(g in hay.lower() for g in own) for own in alternatives), (pattern, hay)
    assert matched > 1500 and looked > 1000
    grams = lambda p: patterns.grams_of(patterns.needs_of_regex(p))
    assert grams("abcd") == [["abc", "bcd"]] and grams("(abc|xyz)d?") == [["abc"], ["xyz"]] and grams("a.c") == grams("(abc)?") == grams("abc|x") == []
    assert patterns.grams_of(patterns.needs_of_like("abc%de_XYZ")) == [["abc", "xyz"]] and patterns.grams_of(patterns.needs_of_like("a%b")) == []


def test_stored_tables_follow_a_rewritten_file(spark, tmp_path):
    import os

    from treelark.plans.model import Model

    def put(text: str) -> None:
        docs = spark.createDataFrame([(1, text, "en", "src", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        docs.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one"))
        part = next((tmp_path / "one").glob("part-*"))
        os.replace(part, tmp_path / "documents.parquet")  # under one name

    put("old line")
    assert [r["verbatim_text"] for r in Model(spark, str(tmp_path)).chunks.collect()] == ["old line"]
    put("a new line of another length")
    spark.catalog.refreshByPath(str(tmp_path))
    assert [r["verbatim_text"] for r in Model(spark, str(tmp_path)).chunks.collect()] == ["a new line of another length"]
