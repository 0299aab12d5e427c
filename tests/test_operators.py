"""Search, navigation, graph, answers, chunking and evaluation on small fixtures (FIXTURES.md part B in own words)."""

import os
import pathlib
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from treelark import plugins
from treelark.functions import text as tx
from treelark.operators import answers as an
from treelark.operators import chunking as ch
from treelark.operators import evaluate as ev
from treelark.operators import graph as kg
from treelark.operators import ingest as ing
from treelark.operators import navigate as nav
from treelark.operators import path_store
from treelark.operators import search as se
from treelark.operators import validate as val
from treelark.operators.path_store import sort_by_path
from treelark.operators.search import scoped
from treelark.plans import catalogue
from treelark.sources import corpus
from treelark.sources.scratch import scratch_folder
from treelark.streaming import traces

RELATIONS = [("REFERENCES", False), ("SUPPORTS", False), ("SEE_ALSO", True)]


def relations(spark):
    return spark.createDataFrame(RELATIONS, "code string, is_symmetric boolean")


@pytest.mark.parametrize(
    ("sim", "rank", "ce", "level"),
    [(0.91, 1, None, "high"), (0.75, 1, None, "medium"), (0.55, 1, None, "low"), (0.91, 999, None, "low"), (0.75, 999, None, "low"), (0.40, 999, None, "none"), (0.91, 1, -1.5, "low")],
)
def test_confidence(spark, sim, rank, ce, level):
    hits = spark.createDataFrame([(1, sim, rank, ce)], "query_id bigint, dense_similarity double, sparse_rank bigint, rerank_score double")
    got = dict(se.confidence(spark.createDataFrame([(1,), (2,)], "query_id bigint"), hits).collect())
    assert got == {1: level, 2: "none"}


def test_venn(spark):
    s = spark.createDataFrame([(1, "s1", 1), (1, "s2", 2)], "query_id bigint, path string, rank bigint")
    v = spark.createDataFrame([(1, "s1", 1), (1, "s3", 2)], "query_id bigint, path string, rank bigint")
    got = [(r["path"], r["found_in"], r["rank"]) for r in se.venn(s, v).orderBy("rank").collect()]
    assert got == [("s1", "both", 1), ("s2", "semantic_only", 2), ("s3", "verbatim_only", 3)]


def test_search_channels(spark):
    chunks = spark.createDataFrame([("d", "d.a", "red apple pie", "red apple pie", 1), ("d", "d.b", "green apple", "green apple", 2), ("e", "e.a", "pie", "pie", 1)], "doc_slug string, path string, verbatim_text string, contextualized_text string, start_line bigint")
    vectors = spark.createDataFrame([("d.a", [1.0, 0.0]), ("d.b", [0.6, 0.8]), ("e.a", [0.0, 0.0])], "path string, embedding array<float>")
    q = spark.createDataFrame([(1, "apple pie", [1.0, 0.0]), (2, "pie", None), (3, "", None)], "query_id bigint, query_text string, query_vector array<float>")
    got = {(r["query_id"], r["path"]): r for r in se.hybrid(q, chunks, vectors, 5).collect()}
    assert set(got) == {(1, "d.a"), (1, "d.b"), (2, "d.a"), (2, "e.a")}
    assert got[1, "d.a"]["dense_rank"] == 1 and got[1, "d.a"]["sparse_rank"] == 1
    assert got[1, "d.b"]["sparse_rank"] == se.NO_RANK and got[2, "e.a"]["dense_rank"] == se.NO_RANK
    p = spark.createDataFrame([(1, " apple "), (2, " "), (3, "A%E")], "query_id bigint, pattern string")
    assert {(r["query_id"], r["path"]) for r in se.grep(p, chunks).collect()} == {(1, "d.a"), (1, "d.b")}
    assert {r["path"] for r in se.grep(p.where("query_id = 3"), chunks, literal=False, case_sensitive=False).collect()} == {"d.a", "d.b"}


def test_rerank_single_hit(spark):
    hits = spark.createDataFrame([(1, 1, "apple", "an apple")], "query_id bigint, rank bigint, query_text string, verbatim_text string")
    r = se.rerank(hits, blend=0.5).first()
    assert r["rerank_score"] == 1.0 and r["new_rank"] == 1
    scorer = plugins.pair_scorer(lambda q, t: [len(x) for x in t])
    assert se.rerank(hits, scorer).first()["rerank_score"] == 8.0


def tree(spark):
    rows = [("d", "d.s_1", "One", 1, 5), ("d", "d.s_1.p_1", "P", 6, 9), ("d", "d.s_2.x", "X", 10, 12), ("d", "d.s_10", "Ten", 13, 14)]
    return spark.createDataFrame(rows, "doc_slug string, path string, title string, start_line bigint, end_line bigint")


def test_navigation(spark):
    t, a = tree(spark), spark.createDataFrame([("d.s_1",), ("d.s_2",), ("d.s_2.x",)], "anchor string")
    pairs = lambda df: sorted((r["anchor"], r["path"], r["relative_depth"]) for r in df.collect())
    assert pairs(nav.children(a, t)) == [("d.s_1", "d.s_1.p_1", 1), ("d.s_2", "d.s_2.x", 1)]
    assert pairs(nav.subtree(a, t)) == pairs(nav.children(a, t))
    assert pairs(nav.parent_chain(a.union(spark.createDataFrame([("d.s_1.p_1",)], "anchor string")), t)) == [("d.s_1.p_1", "d.s_1", -1)]
    assert pairs(nav.siblings(a, t)) == [("d.s_1", "d.s_10", 0), ("d.s_2", "d.s_1", 0), ("d.s_2", "d.s_10", 0)]
    nodes = {r["path"]: r for r in nav.tree_nodes(t).collect()}
    assert (nodes["d"]["node_type"], nodes["d"]["start_line"], nodes["d"]["end_line"]) == ("DOCUMENT", 1, 14)
    assert (nodes["d.s_2"]["node_type"], nodes["d.s_2"]["start_line"], nodes["d.s_2"]["label"]) == ("SECTION", 10, "s_2")
    leaves = dict(nav.expand_leaves(spark.createDataFrame([("d.s_1",), ("d.s_2",), ("zz",)], "query_path string"), t).collect())
    assert leaves == {"d.s_1": ["d.s_1"], "d.s_2": ["d.s_2.x"], "zz": []}


def rows_read(df):
    """Rows that the scan of a table gives out, after df is run without AQE."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [x for x in (leaves.apply(k) for k in range(leaves.size())) if "Scan" in x.nodeName() and "parquet" in x.nodeName()]
    return sum(x.metrics().get("numOutputRows").get().value() for x in scans)


def test_subtrees_read_their_runs_only(spark, tmp_path):
    t = spark.range(200_000).select(F.format_string("a%03d.b%02d.c%d", F.col("id") % 200, F.col("id") % 7, "id").alias("path"), F.lit("d").alias("doc_slug"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sort_by_path(t).write.option("parquet.block.size", 1 << 14).parquet(str(tmp_path / "t"))
        stored = spark.read.parquet(str(tmp_path / "t"))
        one = spark.createDataFrame([("a007.b03",)], "anchor string").coalesce(1)
        assert nav.subtree(one, stored).count() == t.where("path like 'a007.b03.%'").count() > 0
        assert rows_read(nav.subtree(one, stored)) < 0.05 * 200_000  # the row groups that hold the run
        scope = spark.createDataFrame([(1, None, "a007")], "query_id int, doc_slugs array<string>, path_prefix string")
        hits = scoped(scope, stored)
        assert hits.count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("most", [1, 64])
def test_runs_below_anchors_equal_prefix_tests(spark, monkeypatch, most):
    monkeypatch.setattr(path_store, "MOST_RUNS", most)
    paths = ["a", "a.b", "a.b", "a.b.c", "a-b", "a-b.c", "a/b", "ab", "ab.c", "é.x", "é", "b.a.b", "", "a.", None]
    anchors = ["a", "a.b", "a.b", "a-b", "ab.c", "é", "zz", None]
    t = spark.createDataFrame([(p,) for p in paths], "path string")
    for with_self in (False, True):
        got = sorted(map(tuple, path_store.below(spark.createDataFrame([(a,) for a in anchors], "anchor string"), t, "anchor", with_self).select("anchor", "path").collect()))
        want = sorted((a, p) for a in anchors for p in paths if a is not None and p is not None and (p.startswith(a + ".") or (with_self and p == a)))
        assert got == want
    none = spark.createDataFrame([], "anchor string")
    assert path_store.below(none, t).count() == 0 and path_store.below(none, t.limit(0)).count() == 0


def test_walk(spark):
    e = spark.createDataFrame([("a", "b", "REFERENCES", "q"), ("b", "c", "SUPPORTS", "q"), ("c", "a", "SEE_ALSO", "q")], "source string, target string, relation_type string, citation_text string")
    got = {(r["from"], r["to"], r["depth"]) for r in kg.walk(spark.createDataFrame([("a",)], "source string"), e, relations(spark), 2).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("b", "c", 2)}
    back = {(r["from"], r["to"]) for r in kg.walk(spark.createDataFrame([("b",)], "source string"), e, relations(spark), 1, "INCOMING").collect()}
    assert back == {("b", "a")}
    with pytest.raises(ValueError):
        kg.walk(e, e, relations(spark), 9)


def test_walks_are_counted_by_states(spark):
    nodes = range(7)  # every node has an edge to every other one
    e = spark.createDataFrame([(str(a), str(b), "REFERENCES", "q") for a in nodes for b in nodes if a != b], "source string, target string, relation_type string, citation_text string")
    steps = kg.walk(spark.createDataFrame([("0",)], "source string"), e, relations(spark), 4)
    by = {r["depth"]: (r["rows"], r["walks"]) for r in steps.groupBy("depth").agg(F.count("*").alias("rows"), F.sum("walks").alias("walks")).collect()}
    assert by == {1: (6, 6), 2: (30, 30), 3: (30, 120), 4: (30, 360)}  # rows: steps, whatever the number of walks


def test_curation(spark):
    texts = spark.createDataFrame([("d.a", "the quick  fox"), ("d.b.x", "t"), ("d.b.y", "t")], "path string, verbatim_text string")
    rows = [(1, 1, "d.a", "d.b", "SUPPORTS", "quick fox", "why"), (2, 1, "d.a", "d.b", "SUPPORTS", "slow", "why"), (2, 2, "d.a", "d.b", "LIKES", "fox", "why"), (3, 1, "d.a", "d.b", "SUPPORTS", "fox", " ")]
    p = spark.createDataFrame(rows, "batch_id bigint, seq bigint, source string, target string, relation_type string, citation_text string, reason string")
    got = {(r["batch_id"], r["seq"]): (r["violation"], r["accepted"]) for r in kg.validate_proposals(p, texts, relations(spark)).collect()}
    assert got == {(1, 1): (None, True), (2, 1): ("UNGROUNDED_CITATION_TEXT", False), (2, 2): ("INVALID_RELATION_TYPE", False), (3, 1): ("MISSING_REASON", False)}
    plan = kg.plan_additions(p.where("batch_id = 1"), texts)
    assert {r["target"] for r in plan.collect()} == {"d.b.x", "d.b.y"}
    stored = spark.createDataFrame([("d.a", "d.b.x", "SUPPORTS", "c")], "source string, target string, relation_type string, citation_text string")
    added, there = kg.insert_new(plan, stored)
    assert (added.count(), there.count()) == (1, 1)
    assert kg.audit_log(added, stored, "me", "why").count() == 2


def test_answers(spark):
    chunks = spark.createDataFrame([("d", "d.a", "alpha beta"), ("d", "d.b.x", "gamma"), ("d", "d.b.y", "delta")], "doc_slug string, path string, verbatim_text string")
    cite = lambda *c: list(c)
    rows = [
        (1, "text", False, cite(("d.a", "alpha"))), (2, "text [#1]", False, cite(("no.x", "q"))), (3, "text", False, []), (4, "text [#3]", False, cite(("d.a", "alpha"))),
        (5, "cannot say", True, []), (6, "see [#2], [#1] and [#2]", False, cite(("d.b", "gamma"), ("d.b", "delta"))), (7, " ", True, []), (8, "x", False, cite(("d.a", "zeta"))),
    ]
    a = spark.createDataFrame(rows, "answer_id bigint, answer string, abstained boolean, citations array<struct<path: string, citation_text: string>>")
    got = {(r["answer_id"], r["code"]) for r in an.violations(a, chunks, [plugins.answer_rule("SHORT", F.length("answer") < 2)]).collect()}
    assert got == {(2, "PATH_NOT_FOUND"), (3, "MISSING_CITATIONS"), (4, "DANGLING_CITATION_MARKER"), (7, "EMPTY_ANSWER"), (7, "SHORT"), (8, "SHORT"), (8, "UNGROUNDED_CITATION_TEXT")}
    text = dict(an.renumber(a, an.numbered(an.resolved(an.cited(a), chunks))).collect())
    assert text[1] == "text [#1]" and text[6] == "see [#2], [#1] and [#2]" and text[5] == "cannot say" and text[2] == "text"


def test_statutes(spark):
    text = "---\ntitle: \"L\"\n---\n# Luật\n\n## Chương I\n\n#### Điều 1. A\n\nbody one\n\n#### Điều 2. B\nbody two\n\n## Chương II\n### Mục 1\nTiểu mục 1\n\nQUY ĐỊNH\n#### Điều 3. C\nbody three"
    docs = spark.createDataFrame([("luat", text)], "doc_slug string, raw_text string")
    got = {r["path"]: (r["start_line"], r["end_line"]) for r in ch.chunk_statutes(docs).collect()}
    assert got == {"luat.chuong_i.dieu_1": (8, 10), "luat.chuong_i.dieu_2": (12, 13), "luat.chuong_ii.muc_1.tieu_muc_1.dieu_3": (20, 21)}


def test_overview_and_fences(spark):
    text = "---\ntitle: x\n---\n\nlead\n\n## Quick start\n\n```md\n## not a heading\n```\n<!-- gone -->\n## Quick start\nagain"
    docs = spark.createDataFrame([("x", text)], "doc_slug string, raw_text string")
    got = {r["path"]: (r["start_line"], r["end_line"], r["node_type"]) for r in ch.chunk_markdown(docs).collect()}
    assert got == {"x.overview": (5, 5, "OVERVIEW"), "x.quick_start": (7, 11, "SECTION"), "x.quick_start_1": (13, 14, "SECTION")}
    exact = ch.mark_code(ch.lines_of(spark.createDataFrame([("x", "````\n```\n````\nout")], "doc_slug string, raw_text string"))).orderBy("n").collect()
    assert [r["in_code"] for r in exact] == [True, True, True, False]


def test_chunk_rules(spark):
    docs = spark.createDataFrame([("d", "a\nb\nc")], "doc_slug string, raw_text string")
    rows = [("d", "d.a", "a", "[x]\na", 1, 2), ("d", "d.b", "b", "[x]\nb", 2, 2), ("d", "d.c", " ", " ", 3, 3), ("d", "e.c", "c", "[x]\nz", 9, 9), ("d", "d.b", "b", "b", 3, 3)]
    chunks = spark.createDataFrame(rows, "doc_slug string, path string, verbatim_text string, contextualized_text string, start_line bigint, end_line bigint")
    rules = {r["rule"] for r in val.chunk_violations(chunks, docs).collect()}
    assert rules == {"OVERLAP", "EMPTY_VERBATIM", "NAMESPACE_ESCAPE", "OUT_OF_BOUNDS", "CONTEXT_MISMATCH", "DUPLICATE_PATH"}


@pytest.mark.parametrize(("b", "c", "p"), [(9, 0, 0.0039), (14, 4, 0.0309), (7, 0, 0.0156), (12, 4, 0.0768), (17, 8, 0.1078), (2, 9, 0.0654), (2, 0, 0.5), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    got = spark.range(1).select(ev.mcnemar_p(F.lit(b).cast("long"), F.lit(c).cast("long")).alias("p")).first()["p"]
    assert round(got, 4) == p


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "k string, id string, v string")
    new = spark.createDataFrame([("b", "9", None), ("c", "3", "z")], "k string, id string, v string")
    rows = lambda df: sorted((r["k"], r["id"], r["v"]) for r in df.collect())
    assert [r for r in rows(ing.upsert(old, new, "k", ("id",), ("v",)))] == [("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z")]


def test_traces(spark):
    rows = [("s", 1, "2024-01-01 00:00:00", "tool_start", "t", "x", None), ("s", 2, "2024-01-01 00:00:01", "tool_start", "t", None, None), ("s", 3, "2024-01-01 00:00:02", "tool_done", "t", None, None), ("s", 4, "2024-01-01 00:00:03", "tool_error", "t", None, 5.0), ("s", 5, "2024-01-01 00:00:04", "tool_done", "t", "o", None), ("s", 6, "2024-01-01 00:00:05", "tool_start", "t", None, None)]
    e = spark.createDataFrame(rows, "session string, event_id bigint, ts string, kind string, tool string, args string, elapsed_ms double").withColumn("ts", F.to_timestamp("ts"))
    got = {(r["start_id"], r["end_id"], r["status"], r["elapsed_ms"]) for r in traces.traces(e).collect()}
    assert got == {(2, 3, "done", 1000.0), (1, 4, "error", 5.0), (None, 5, "done", None), (6, None, "running", None)}


EVENT = "session string, event_id bigint, ts timestamp, kind string, tool string, args string, elapsed_ms double"


def arriving(spark, folder, files):
    """A stream with one file a trigger."""
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, EVENT.replace("ts timestamp", "s bigint")).withColumn("ts", F.timestamp_seconds("s")).select("session", "event_id", "ts", "kind", "tool", "args", "elapsed_ms")
        df.coalesce(1).write.parquet(f"{folder}/tmp{k}")
        for f in sorted(pathlib.Path(f"{folder}/tmp{k}").glob("part-*")):
            (folder / "in").mkdir(exist_ok=True)
            f.rename(folder / "in" / f"{len(list((folder / 'in').iterdir())):03d}.parquet")
            os.utime(folder / "in" / sorted(os.listdir(folder / "in"))[-1], (1e9 + len(os.listdir(folder / "in")),) * 2)
    return lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_recent_stream(spark, tmp_path):
    event = lambda k: (str(k % 2), k, k, "tool_start", "t", None, None)
    first = arriving(spark, tmp_path, [[event(k) for k in range(10)], [event(k) for k in (27, 3, 21, 11)]])
    got = traces.recent_stream(first(), str(tmp_path / "store"), 3)
    assert sorted(r["event_id"] for r in got.collect()) == [4, 6, 8, 11, 21, 27]
    files = set(os.listdir(tmp_path / "store" / "rows"))
    more = arriving(spark, tmp_path / "x", [[event(k) for k in range(20, 30)]])  # a stream that goes on where the first one stopped
    for f in (tmp_path / "x" / "in").iterdir():
        f.rename(tmp_path / "in" / "later.parquet")
    got = traces.recent_stream(first(), str(tmp_path / "store"), 3)
    assert sorted(r["event_id"] for r in got.collect()) == [24, 25, 26, 27, 28, 29] and {r["kind"] for r in got.collect()} == {"tool_start"}
    assert files <= set(os.listdir(tmp_path / "store" / "rows"))  # nothing was written anew
    log = spark.read.parquet(str(tmp_path / "store" / "rows"))
    assert log.count() < 40  # only what enters and leaves the lists
    assert traces.recent_stream(first(), str(tmp_path / "store"), 3).count() == 6 and more is not None


def test_trace_stream_does_not_depend_on_triggers(spark, tmp_path):
    """Out of order within the watermark, in one trigger or in many, with a session that holds most events: the same traces; late events are dropped."""
    rng = random.Random(4)
    rows = [("hot" if k % 3 else f"s{k % 5}", k + 1, 60_000 + 60 * k + rng.randrange(-200, 200), rng.choice(["tool_start", "tool_start", "tool_done", "tool_error"]), "t", str(k), None) for k in range(240)]
    rows.append(("end", 999, 84_000, "tool_start", "t", None, None))
    order = sorted(rows, key=lambda r: r[1])
    got = []
    for name, files in (("one", [order]), ("many", [order[k : k + 61] for k in range(0, len(order), 61)])):
        (tmp_path / name).mkdir()
        stream = arriving(spark, tmp_path / name, files)
        found = traces.run_to_end(traces.stream_traces(stream()), str(tmp_path / name / "out"))
        got.append(sorted((r["session"], r["start_id"] or -1, r["end_id"] or -1, r["status"], r["args"], r["elapsed_ms"] or -1) for r in found.collect()))
    assert got[0] == got[1]
    want, running = [], {}
    for s, k, at, kind, _, args, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        calls = running.setdefault(s, [])
        want += [(s, c[0], -1, "unfinished", c[2], -1) for c in calls if c[1] + 3600 < at]
        calls[:] = [c for c in calls if c[1] + 3600 >= at]
        if kind == "tool_start":
            calls.append((k, at, args))
        else:
            c = calls.pop() if calls else (-1, None, None)
            want.append((s, c[0], k, kind[5:], args, (at - c[1]) * 1e3 or -1 if c[1] is not None else -1))
    mark = 84_000 - 600
    want += [(s, c[0], -1, "unfinished", c[2], -1) for s, calls in running.items() for c in calls if ((c[1] + 3600) // 600 + 1) * 600 <= mark]
    assert len(want) > 100 and sorted(set(got[0]) ^ set(want)) == []


def test_accepted_proposals_are_those_of_good_batches(spark):
    texts = spark.createDataFrame([("d.a", "one  two\tthree"), ("d.b", "four"), ("d.c", " "), ("d.d", None), ("d.e.f", "one two")], "path string, verbatim_text string")
    rng, rows = random.Random(2), []
    for batch in range(120):
        for seq in range(rng.randrange(1, 4)):
            odd = lambda usual, others: rng.choice(others) if rng.random() < 0.12 else usual
            source, quote = rng.choice([("d.a", "one two three"), ("d.a", "two \n three"), ("d.b", "four"), ("d.e.f", "one")])
            rows.append((batch if batch else None, seq, odd(source, ["d.c", "d.d", "d", None]), odd("d", ["d.b", "d.e", "x", None]), odd("SUPPORTS", ["LIKES", None]), odd(quote, ["five", " ", "", None]), odd("why", ["", None])))
    p = spark.createDataFrame(rows, "batch_id int, seq int, source string, target string, relation_type string, citation_text string, reason string")
    want = kg.validate_proposals(p, texts, relations(spark)).where("accepted").select(*p.columns).collect()
    assert 20 < len(want) < 200 and sorted(map(repr, kg.accepted_proposals(p, texts, relations(spark)).select(*p.columns).collect())) == sorted(map(repr, want))


def test_planning_reads_texts_of_accepted_batches_alone(spark):
    """What is shuffled for a plan is no more than a part of the texts: most batches of the registered query are not accepted."""
    store = spark._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    catalogue.QUERIES["kg_plan_additions"](spark, "/root/testdata/sf0.01").count()  # the chunks are stored
    before = shuffled()
    catalogue.QUERIES["kg_plan_additions"](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    print("SHUFFLED", shuffled() - before)
    assert shuffled() - before < 2_500_000


def test_new_edges_are_planned_once(spark, monkeypatch):
    made, plan = [], kg.plan_additions
    monkeypatch.setattr(kg, "plan_additions", lambda *a: made.append(1) or plan(*a))
    catalogue.QUERIES["kg_insert_new"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_scratch_tables_of_an_ingest_go_with_it(spark, tmp_path):
    root = pathlib.Path(scratch_folder(spark, "x")).parent
    before = set(os.listdir(root)) if root.exists() else set()
    docs = spark.createDataFrame([("a.md", "a", "x\ny"), ("b.md", "b", "z")], "file string, doc_slug string, raw_text string")
    got = ing.ingest_documents(docs, line_profiles(), str(tmp_path / "store"), 0)
    again = ing.ingest_documents(docs.where("doc_slug = 'a'"), line_profiles(), str(tmp_path / "store"), 1)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"ingest-summary"}
    assert (got.first()["chunks"], got.first()["embedded"], again.first()["chunks"], again.first()["embedded"]) == (3, 3, 3, 0)


class Store:
    """A state store of one key that counts its calls; stands for the handle, a value and a map."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def counted(name):
        def call(self, *args):
            self.calls += 1
            return {
                "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None), "getValue": lambda k: self.map[k],
                "updateValue": lambda k, v: self.map.update({k: v}), "removeKey": lambda k: self.map.pop(k), "registerTimer": lambda t: self.timers.add(t), "containsKey": lambda k: k in self.map, "exists": lambda: self.value is not None,
            }[name](*args)

        return call

    get, update, clear, getValue, updateValue, removeKey, registerTimer, containsKey, exists = map(counted, "get update clear getValue updateValue removeKey registerTimer containsKey exists".split())


@pytest.mark.parametrize("limit", [1, 4, 64, 1024])
def test_state_of_a_session(limit):
    """Whatever waits in blocks: the same traces as folded at once. Few calls of the store, none that is left when all is done."""
    rng = random.Random(limit)
    for timeout in (3_600_000, 1_000_000):
        rows = [Row(ms=rng.randrange(0, 200) * 97_000 + 600_000, event_id=k, tool=rng.choice("ab"), kind=rng.choice(["tool_start", "tool_done", "x"]), args=None, elapsed_ms=None) for k in range(500)]
        got = []
        for size in (500, 60):
            own = traces.CallsOfASession(600_000, timeout, limit)
            store, found, mark = Store(), [], 0
            own.init(store)
            given = rows if size == 500 else sorted(rows, key=lambda r: r.ms + rng.randrange(5_000_000))
            for k in range(0, 500 + 2 * size, size):
                some = given[k : k + size]
                if some:
                    list(own.handleInputRows(("s",), iter(some), None))
                mark = max(mark, min([r.ms for r in given[k + size :]], default=mark + 10**8) - 1)
                while due := [t for t in store.timers if t < mark]:
                    found += own.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None)
                    store.timers.discard(min(due))
                if size == 500 and k == 0:
                    assert limit < 1024 or store.calls < 10
            assert store.value is None and not store.map and not store.timers
            got.append(sorted((r["tool"], r["start_id"] or -1, r["end_id"] or -1, r["status"], r["elapsed_ms"] or -1) for r in found))
        want, running = [], {"a": [], "b": []}
        for r in sorted(rows, key=lambda r: (r.ms, r.event_id)):
            own = running[r.tool]
            want += [(r.tool, c.event_id or -1, -1, "unfinished", -1) for c in own if c.ms + timeout < r.ms]
            own[:] = [c for c in own if c.ms + timeout >= r.ms]
            if r.kind == "tool_start":
                own.append(r)
            else:
                c = own.pop() if own else None
                want.append((r.tool, c.event_id or -1 if c else -1, r.event_id or -1, "done" if r.kind == "tool_done" else "error", float(r.ms - c.ms) or -1 if c else -1))
        want += [(t, c.event_id or -1, -1, "unfinished", -1) for t, own in running.items() for c in own]
        assert got[0] == got[1] == sorted(want)


def line_profiles():
    def cut(docs):
        lines = ch.lines_of(docs).where("trim(line) <> ''")
        return lines.select("doc_slug", F.concat("doc_slug", F.lit(".s_"), F.col("n").cast("string")).alias("path"), F.col("line").alias("verbatim_text"), F.concat(F.lit("[x]\n"), "line").alias("contextualized_text"), F.col("n").alias("start_line"), F.col("n").alias("end_line"), F.lit("SECTION").alias("node_type"))

    own = plugins.Profiles()
    own.register(plugins.Profile("lines", lambda file, text: file.endswith(".md"), cut))
    return own


def store_rows(spark, store, version):
    t = ing.read_store(spark, store, version)
    return {name: sorted(map(repr, t[name].drop("embedding").collect())) for name in t}


DRAFTS = "source_path string, target_path string, relation_type string, citation_text string, rationale string, seq int"


def test_store_writes_touched_buckets_only(spark, tmp_path):
    docs = spark.createDataFrame([(f"{k}.md", f"d{k}", f"one {k}\ntwo\nthree") for k in range(100)], "file string, doc_slug string, raw_text string")
    drafts = spark.createDataFrame([(f"d{k}.s_1", f"d{(k + 1) % 100}.s_3", "SUPPORTS", "c", None, k) for k in range(100)], DRAFTS)
    store = str(tmp_path / "store")
    first = ing.ingest_documents(docs, line_profiles(), store, 0, drafts, relations(spark)).first().asDict()
    assert first == {"documents": 100, "chunks": 300, "edges": 100, "embedded": 300, "skipped": 0, "quarantined": 0}
    changed = spark.createDataFrame([("7.md", "d7", "one 7\ntwo changed")], docs.schema)  # its third line goes, and with it the edge of d6
    second = ing.ingest_documents(changed, line_profiles(), store, 1).first().asDict()
    assert second == {"documents": 100, "chunks": 299, "edges": 99, "embedded": 1, "skipped": 0, "quarantined": 0}
    written = {(p.parent.parent.name, p.parent.name) for p in (tmp_path / "store/data/v2").rglob("part-*")}
    slot = {r["doc_slug"]: r["b"] for r in docs.select("doc_slug", ing.bucket_of("doc_slug", ing.BUCKETS).alias("b")).collect()}
    assert written == {("documents", f"bucket={slot['d7']}"), ("chunks", f"bucket={slot['d7']}"), ("edges", f"bucket={slot['d6']}")} or slot["d6"] == slot["d7"] or not any(v == slot["d6"] and k != "d6" for k, v in slot.items())
    assert len(ing.read_store(spark, store, 1)["chunks"].collect()) == 300  # the version before is as it was


def test_ingest_stream_survives_a_killed_trigger(spark, tmp_path, monkeypatch):
    rows = [(f"{k}.{'bin' if k % 5 == 0 else 'md'}", f"d{k}", f"line {k}\n\nother {k}") for k in range(30)]
    schema = "file string, doc_slug string, raw_text string"
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write, calls = ing.Store.write, []

    def failing(self, name, *more):
        calls.append(name)
        if name == "documents" and calls.count("documents") == 2:  # the second batch, between tables
            raise RuntimeError("killed")
        return write(self, name, *more)

    drafts = spark.createDataFrame([(f"d{k}.s_1", f"d{k}.s_3", "SUPPORTS", "c", None, k) for k in range(30)], DRAFTS)
    take = lambda: ing.ingest_stream(stream(), line_profiles(), str(tmp_path / "store"), str(tmp_path / "state"), drafts=drafts, relations=relations(spark))
    monkeypatch.setattr(ing.Store, "write", failing)
    with pytest.raises(Exception, match="killed"):
        take()
    monkeypatch.setattr(ing.Store, "write", write)
    assert take() == 3 and take() == 3  # nothing new: nothing is done
    ing.ingest_documents(spark.createDataFrame(rows, schema), line_profiles(), str(tmp_path / "whole"), 0, drafts, relations(spark))
    assert store_rows(spark, str(tmp_path / "store"), 3) == store_rows(spark, str(tmp_path / "whole"), 1)


def test_corpus_files_and_cases(spark, tmp_path):
    (tmp_path / "Guide").mkdir()
    (tmp_path / ".git").mkdir()
    for name in ("Guide/A b.md", "Guide/c.txt", ".git/x.md", "d.MDX"):
        (tmp_path / name).write_text("# t")
    assert {r["doc_slug"] for r in corpus.corpus_files(spark, str(tmp_path), "ns").collect()} == {"ns.guide.a_b"}
    (tmp_path / "cases.jsonl").write_text('{"id": "e001", "test_set": "dev", "doc_slugs": ["a.b"], "expected": [{"path": "a.b.c.d"}]}\n')
    case = corpus.read_cases(spark, str(tmp_path / "cases.jsonl")).first()
    assert [tuple(x) for x in case["expected"]] == [("a.b", "c.d")]
    corpus.write_cases(corpus.read_cases(spark, str(tmp_path / "cases.jsonl")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "test_set=dev").exists()
    (tmp_path / "pay").mkdir()
    (tmp_path / "pay" / "batch_03.json").write_text('[{"id": "1", "arguments": {"query": "q"}}, {"id": "2", "arguments": {"query": "r"}}]')
    assert [r["batch"] for r in corpus.read_payloads(spark, str(tmp_path / "pay")).collect()] == ["03", "03"]


def test_profiles(spark):
    own = plugins.Profiles()
    own.register(plugins.Profile("md", lambda f, t: f.endswith(".md"), ch.chunk_markdown))
    with pytest.raises(ValueError):
        own.register(plugins.Profile("md", lambda f, t: f.isNotNull(), ch.chunk_markdown))
    docs = spark.createDataFrame([("a.md", "a", "# T\nx"), ("b.bin", "b", "x")], "file string, doc_slug string, raw_text string")
    chunks, rest = own.chunk(docs)
    assert chunks.count() == 1 and [r["doc_slug"] for r in rest.collect()] == ["b"]
    encoded = ing.embed(spark.createDataFrame([("a b",), (None,)], "t string"), "t", 8).collect()
    assert abs(sum(x * x for x in encoded[0]["embedding"]) - 1) < 1e-6


def test_outcomes_of_nested_targets(spark):
    """Two targets, one below the other: each path counts for one, so that nDCG stays within 1; the last one tells channel and path."""
    hits = spark.createDataFrame([("c", 1, 1, "d.a.b", "both"), ("c", 1, 2, "d.a.x", "verbatim_only"), ("c", 2, 1, "z", "both")], "config string, case_id bigint, rank bigint, path string, found_in string")
    targets = spark.createDataFrame([(1, "d.a"), (1, "d.a.b"), (2, "q")], "case_id bigint, target string")
    got = {r["case_id"]: r for r in ev.outcomes(hits, targets).collect()}
    assert (got[1]["found"], got[1]["rank_10"], got[1]["found_in"], got[1]["matched_path"]) == (True, 1, "both", "d.a.b")
    assert 0 < got[1]["ndcg_10"] <= 1
    assert (got[2]["found"], got[2]["found_in"], got[2]["matched_path"], got[2]["ndcg_10"]) == (False, "missed", None, 0.0)


def test_dense_search_of_unlike_lengths(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0]), ("d", [])], "path string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0]), (3, []), (4, None)], "query_id bigint, query_vector array<float>")
    assert {(r["query_id"], r["path"]) for r in se.dense_top(q, corpus, 5).collect()} == {(1, "b"), (1, "c"), (2, "a")}


def test_grep_by_inner_words_equals_a_scan(spark):
    import random

    r = random.Random(5)
    word = lambda: r.choice(["al", "be", "Ga", "de_l", "é", "x1"])
    texts = ["".join(word() + r.choice([" ", ", ", "-", "."]) for _ in range(12)) for _ in range(150)]
    chunks = spark.createDataFrame([(f"p{i}", t, f"[x]\n{t}") for i, t in enumerate(texts)], "path string, verbatim_text string, contextualized_text string")
    patterns = [t[a : a + r.randint(1, 14)].strip() for t in texts[:40] for a in [r.randrange(20)]] + ["x]", "%", "al-be"]
    p = spark.createDataFrame([(i, t) for i, t in enumerate(patterns)], "query_id bigint, pattern string")
    for same, fold in ((True, str), (False, str.lower)):
        want = {(i, f"p{j}") for i, q in enumerate(patterns) for j, t in enumerate(texts) if q and fold(q) in fold(f"[x]\n{t}")}
        assert {(x["query_id"], x["path"]) for x in se.grep(p, chunks, case_sensitive=same).collect()} == want


def test_similar_texts_are_those_of_the_join(spark, monkeypatch):
    words = ["a", "ab", "Ñandú", "école", "straße", "x_1", "漢字", "the", "that", "then", "𝒳y"]
    texts = [" ".join(words[(k * j + j * j) % 11] for j in range(1, 2 + k % 7)) for k in range(60)] + ["", "...", None, "a " * 5000, "the then"]
    rows = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    q = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:40:3] + ["", "the then", "…"])], "query_id int, pattern string")
    want = se.similar_sets(q.select("query_id", tx.trigrams(F.col("pattern")).alias("set")), rows.select("path", tx.trigrams(F.col("text")).alias("set")), 0.3).collect()
    assert len(want) > 100
    for block, scans, cube, letters in ((256, 16, 1 << 24, 1 << 19), (5, 16, 1 << 24, 40), (256, 16, 0, 1 << 19), (1, 1, 0, 1)):
        for name, value in {"SIMILAR_BLOCK": block, "SIMILAR_SCANS": scans, "CUBE": cube, "SLICE_LETTERS": letters}.items():
            monkeypatch.setattr(se, name, value)
        found = se.similar_texts(q, rows, "text", 0.3).select("query_id", "path", "similarity").collect()
        assert sorted(found) == sorted(want)


def test_similar_lines_are_found_where_they_are_read(spark):
    plan = catalogue.QUERIES["se_trigram_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "MapInArrow" in plan
