"""What queries shuffle and hold must not grow faster than their tables."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from treelark.operators import search as se


def exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_sparse_scores_are_made_where_the_texts_are_read(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(f"d.s_{i}", say(rng.randint(0, 9))) for i in range(400)]
    asked = [(i, say(rng.randint(0, 5))) for i in range(1, 40)]
    chunks, queries = spark.createDataFrame(texts, "path string, contextualized_text string").repartition(3), spark.createDataFrame(asked, "query_id bigint, query_text string")
    want = {}
    for q, t in asked:
        own, pairs = set(t.split()), set(zip(t.split(), t.split()[1:]))
        for p, x in texts:
            tf = Counter(x.split())
            hit = own & set(tf)
            if own and (hit == own or pairs & set(zip(x.split(), x.split()[1:]))):
                r = sum(0.1 * sum(1 / j**2 for j in range(1, tf[w] + 1)) / 1.644934 for w in hit) / len(own)
                want[q, p] = (round(r / (r + 1), 6), hit == own)
    monkeypatch.setattr(se, "MET", 300)
    monkeypatch.setattr(se, "QUERY_WORDS", 20)
    pool = se.sparse_pool(queries, chunks)
    assert {(r["query_id"], r["path"]): (r["base"], r["all_match"]) for r in pool.collect()} == want
    cut = {(r["query_id"], r["path"]) for r in se.top(se.sparse_pool(queries, chunks, k=7), "n", 7, F.desc("base"), F.col("path")).collect()}
    best = {q: sorted((-b, p) for (k, p), (b, _) in want.items() if k == q)[:7] for q, _ in asked}
    assert cut == {(q, p) for q, own in best.items() for _, p in own}
    assert exchanges(se.sparse_pool(queries, spark.createDataFrame(texts, "path string, contextualized_text string"))) == 0


def test_texts_stay_where_they_are_read(spark, tmp_path):
    """A line is stored once, without its context; what a word finds is picked by a broadcast of keys, and patterns that share an id are told apart."""
    from treelark.plans.model import STORED, Model

    docs = [(i, f"Alpha needle{i} omega\nbeta x\n \nlast", "en", "s1", 9) for i in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    m = Model(spark, str(tmp_path))
    chunks = {r["path"]: r for r in m.chunks.collect()}
    assert len(chunks) == 18 and chunks["s1.doc_3.s_4"]["contextualized_text"] == "[s1 > doc_3]\nlast" and chunks["s1.doc_3.s_1"]["doc_slug"] == "s1.doc_3"
    assert spark.read.parquet(STORED[spark.sparkContext.applicationId, str(tmp_path), "chunks"][1]).columns == ["doc_id", "source", "n", "line"]
    patterns = spark.createDataFrame([(1, "Alpha needle2 omega"), (1, "beta x"), (2, "a needle4 o"), (3, "none of this")], "query_id bigint, pattern string")
    found = se.grep(patterns, m.chunks)
    got = sorted((r["query_id"], r["pattern"], r["path"]) for r in found.collect())
    assert got == [(1, "Alpha needle2 omega", "s1.doc_2.s_1"), *((1, "beta x", f"s1.doc_{i}.s_2") for i in range(6))] + [(2, "a needle4 o", "s1.doc_4.s_1")] * ("a needle4 o" in "Alpha needle4 omega")
    assert "BroadcastHashJoin [path" in found._jdf.queryExecution().sparkPlan().toString() and "LeftSemi" in found._jdf.queryExecution().sparkPlan().toString()


def test_expressions_shuffle_nothing(spark, monkeypatch):
    rows = [(f"p{i}", t, t and t.upper()) for i, t in enumerate(["the cat sat", "a catalogue", "", "dog\ncat", "Ünder cät", "xx", None])]
    chunks = spark.createDataFrame(rows, "path string, verbatim_text string, contextualized_text string").repartition(2)
    asked = [(1, "cat[a-z]+"), (2, "(dog|sat)"), (3, "c.t"), (4, "CAT"), (4, "^xx$"), (5, "nothing here")]
    patterns = spark.createDataFrame(asked, "query_id bigint, pattern string")
    monkeypatch.setattr(se, "MET", 20)
    found = se.grep(patterns, chunks, regex=True)
    got = {(r["query_id"], r["pattern"], r["path"]) for r in found.collect()}
    assert got == {(1, "cat[a-z]+", "p1"), (2, "(dog|sat)", "p0"), (2, "(dog|sat)", "p3"), (3, "c.t", "p0"), (3, "c.t", "p1"), (3, "c.t", "p3"), (3, "c.t", "p4"), (4, "CAT", "p0"), (4, "CAT", "p1"), (4, "CAT", "p3"), (4, "^xx$", "p5")}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_leaves_are_compared_only_where_containers_may_share_them(spark):
    from treelark.operators import graph as kg

    texts = spark.createDataFrame([(p, "t") for p in ("d.a", "d.b.x", "d.b.y", "e.z")], "path string, verbatim_text string")
    rows = [("d.a", "d", "R", 5, "late"), ("d.a", "d.b", "R", 2, "first"), ("d.a", "d.b", "R", 1, "twin"), ("e.z", "d.b", "R", 3, "alone"), ("e.z", "d.b", "R", 9, "again")]
    plan = kg.plan_additions(spark.createDataFrame(rows, "source string, target string, relation_type string, seq bigint, citation_text string"), texts)
    got = sorted((r["source"], r["target"], r["citation_text"]) for r in plan.collect())
    assert got == [("d.a", "d.b.x", "twin"), ("d.a", "d.b.y", "twin"), ("e.z", "d.b.x", "alone"), ("e.z", "d.b.y", "alone")]
    physical = plan._jdf.queryExecution().sparkPlan().toString()
    assert "Union" in physical and physical.count("Window [") == 1  # leaves of the other branch are given out as they are


def test_a_line_with_tags_is_made_once(spark):
    """What is asked several times of a value is asked of one value: the text of a line is not made anew for each."""
    from treelark.operators.chunking import normalise_markup

    rows = spark.createDataFrame([("a `<b>` <Image alt=\"x\" src=\"y\"/> <b>z</b>",), (None,)], "raw string")
    df = rows.select(normalise_markup(F.reverse(F.reverse("raw"))).alias("x"))
    assert [r["x"] for r in df.collect()] == ["a `<b>` ![x](y) z", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(raw") == 1


def test_a_label_is_made_once(spark):
    from treelark.functions import paths as p

    rows = spark.createDataFrame([(" Ünder ĳ½ Đ ",), ("plain-Text 7",), ("й",), ("--",), (None,), ("İx",)], "raw string")
    df = rows.select(p.sanitise_label(F.col("raw")).alias("x"))
    assert [r["x"] for r in df.collect()][:2] == ["under_ij1_2_d", "plain_text_7"]
    assert [r["x"] for r in df.collect()][2][:2] == "u_" and [r["x"] for r in df.collect()][3:5] == [None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(raw") == 1
    points = spark.createDataFrame([(chr(c),) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000], "c string")
    assert {r["c"] for r in points.where(F.col("c").rlike(p.SPELT)).collect()} == {c for c in p.SEVERAL if ord(c) < 0x20000}


def test_siblings_are_given_out_where_rows_are_read(spark):
    from treelark.operators import navigate as nav

    paths = ["r", "r.a", "r.b", "r.c", "r.a.x", "r.a.y", "s.a"]
    chunks = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, start_line int")
    anchors = spark.createDataFrame([("r",), ("r.a",), ("r.a",), ("r.a.x",), ("r.zz",), (None,)], "anchor string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = nav.siblings(anchors, chunks)
        got = sorted((r["anchor"], r["path"], r["relative_depth"]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [*(("r.a", p, 0) for p in ("r.b", "r.b", "r.c", "r.c")), ("r.a.x", "r.a.y", 0), *(("r.zz", p, 0) for p in ("r.a", "r.b", "r.c"))]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "split(" not in plan


def test_quotes_are_summed_up_where_they_meet_their_leaves(spark):
    from treelark.operators import answers as an

    chunks = spark.createDataFrame([("d.a", "d", "one two"), ("d.b", "d", "say  this"), ("e.a", "e", "say this")], "path string, doc_slug string, verbatim_text string")
    cited = spark.createDataFrame([(1, 1, "d", "say this"), (1, 2, "d", "never"), (1, 3, "d", None), (2, 1, "none", "x")], "answer_id bigint, i int, path string, citation_text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = an.resolved(cited, chunks)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["answer_id"], r["i"], r["leaf"], r["doc_slug"], r["verbatim_text"], r["grounded"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == (1, 1, "d.b", "d", "say  this", True) and [x[2] for x in got[1:]] == ["d.a", "d.a", None]
    assert "hashpartitioning(answer_id" not in plan


def test_lines_look_behind_without_going_through_all_of_them_anew(spark):
    """No window ends with the last line of a document unless it holds all of it: Spark's work for such a frame grows with the square of the lines."""
    from treelark.operators import chunking as ch

    lines = spark.createDataFrame([("d", i, t, False) for i, t in enumerate(["Tiểu mục 2", "", "CHUNG", "Tiểu mục 3", "Chung", "<Image", 'src="/a"', "/>", "<Image", "x"], 1)], "doc_slug string, n bigint, line string, in_code boolean")
    heads = lines.selectExpr("doc_slug", "n", "3 as level", "'`f(' || n || ')`' as title", "n % 3 <> 0 as empty")
    frames = {"statutes": ch.normalise_statutes(lines), "tags": ch.join_tags(lines), "comments": ch.version_comments(lines), "overloads": ch.fold_overloads(heads)}
    for name, df in frames.items():
        frame = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.findall(r"RowFrame, (?!unboundedpreceding)[^,]*, unboundedfollowing", frame), name
    said = {k: [r["line"] for r in frames[k].orderBy("n").collect()] for k in ("statutes", "tags")}
    assert said["statutes"][:5] == ["### Tiểu mục 2: CHUNG", "", "", "### Tiểu mục 3", "Chung"]
    assert said["tags"][5:] == ["", "", '<Image src="/a" />', "<Image", "x"]
    assert [(r["target"], r["start_line"], r["titles"]) for r in frames["overloads"].orderBy("target").collect()][0] == (3, 1, ["`f(1)`", "`f(2)`", "`f(3)`"])


def test_texts_of_lines_are_dealt_out_once_for_fences_and_sections(spark):
    """Code, front matter and sections are found by windows over one deal of the lines by document, not by joins of the texts; a section costs no array."""
    from treelark.operators import chunking as ch

    text = "---\ntitle: T\n---\n# A\n```js\n# no\n```\nx\n### B\n## C\n```\nopen"
    docs = spark.createDataFrame([("d", text), ("e", "```\n~~~\n```\n# E"), ("f", "---\nnever closed")], "doc_slug string, raw_text string")
    lines, _ = ch.front_matter(ch.lines_of(docs))
    coded = ch.mark_code(lines)
    assert "Join" not in coded._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["doc_slug"], r["n"], r["line"], r["block"]) for r in coded.where("in_code or n = 1").orderBy("doc_slug", "n").collect()]
    assert got == [("d", 1, "", None), ("d", 5, "```js", 1), ("d", 6, "# no", 1), ("d", 7, "```", 1), ("d", 11, "```", 2), ("d", 12, "open", 2),
                   ("e", 1, "```", 1), ("e", 2, "~~~", 1), ("e", 3, "```", 1), ("f", 1, "---", None)]
    tree = ch.section_tree(ch.headings(coded))
    assert "array" not in tree._jdf.queryExecution().optimizedPlan().toString().split("Union")[0].lower()
    assert [(r["n"], r["section"], r["parent"]) for r in tree.where("doc_slug = 'd' and n > 3").orderBy("n").collect()] == [(4, 4, None), (5, 4, None), (6, 4, None), (7, 4, None), (8, 4, None), (9, 9, 4), (10, 10, 4), (11, 10, None), (12, 10, None)]
