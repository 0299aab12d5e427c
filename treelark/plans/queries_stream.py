"""Event, stream and plug-in queries, and sinks that are read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark import plugins
from treelark.operators import answers as an
from treelark.operators import chunking as ch
from treelark.operators import ingest as ing
from treelark.operators import search as se
from treelark.plans.model import C, Model
from treelark.plans.queries_graph import answers
from treelark.plans.queries_search import BASE, hybrid
from treelark.plans.registry import query
from treelark.sources import corpus
from treelark.sources.scratch import scratch_folder
from treelark.streaming import traces as st


def events(m: Model) -> DataFrame:
    """Tool events: the user is the session, the type the tool, and the kind goes by the id."""
    kind = F.element_at(F.array(F.lit("tool_start"), F.lit("tool_done"), F.lit("tool_error")), (F.col("event_id") % 3 + 1).cast("int"))
    took = F.when(F.col("event_id") % 3 == 1, F.col("value"))
    return m.table("events").select(F.col("user_id").cast("string").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("args"), took.cast("double").alias("elapsed_ms"))


# the open calls of each session and tool as a list that is walked event by event
TRACES = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, event_type AS tool, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT session, tool, 0::BIGINT AS k, []::BIGINT[] AS running, NULL::BIGINT AS start_id, NULL::BIGINT AS end_id FROM e
 UNION ALL SELECT session, tool, e.k, CASE WHEN event_id % 3 = 0 THEN list_append(running, event_id) ELSE running[1:-2] END, CASE WHEN event_id % 3 <> 0 THEN running[-1] END, CASE WHEN event_id % 3 <> 0 THEN event_id END
 FROM r JOIN e USING (session, tool) WHERE e.k = r.k + 1),
closed AS (SELECT session, tool, start_id, end_id, CASE WHEN end_id % 3 = 1 THEN 'done' ELSE 'error' END AS status FROM r WHERE end_id IS NOT NULL),
still AS (SELECT session, tool, unnest(running) AS start_id FROM (SELECT *, max(k) OVER (PARTITION BY session, tool) AS last FROM r) WHERE k = last)"""
_TIMED = "CASE WHEN t.end_id % 3 = 1 AND z.value IS NOT NULL THEN z.value ELSE (epoch_us(z.ts) - epoch_us(a.ts)) / 1000.0::DOUBLE END"
_ARGS = "coalesce(CASE WHEN t.end_id % 2 = 0 THEN z.props END, CASE WHEN t.start_id % 2 = 0 THEN a.props END)"


@query("st_tool_trace", f"""{TRACES}, t AS (SELECT * FROM closed UNION ALL SELECT session, tool, start_id, NULL, 'running' FROM still)
 SELECT session, tool, start_id, end_id, status, {_ARGS} AS args, round({_TIMED}, 3) AS elapsed_ms FROM t LEFT JOIN events a ON a.event_id = start_id LEFT JOIN events z ON z.event_id = end_id""")
def st_tool_trace(m: Model) -> DataFrame:
    return st.traces(events(m)).withColumn("elapsed_ms", F.round("elapsed_ms", 3))


STREAMED = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, event_type AS tool, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) AS k FROM events),
r AS (SELECT DISTINCT session, tool, 0::BIGINT AS k, []::STRUCT(id BIGINT, ms BIGINT)[] AS running, NULL::BIGINT AS start_id, NULL::BIGINT AS end_id, NULL::BIGINT AS end_ms FROM e
 UNION ALL SELECT session, tool, k, CASE WHEN event_id % 3 = 0 THEN list_append(alive, {'id': event_id, 'ms': ms}) ELSE alive[1:-2] END, CASE WHEN event_id % 3 <> 0 THEN alive[-1].id END, CASE WHEN event_id % 3 <> 0 THEN event_id END, CASE WHEN event_id % 3 <> 0 THEN ms END
 FROM (SELECT session, tool, e.k, event_id, e.ms, list_filter(running, lambda x: x.ms + 3600000 >= e.ms) AS alive FROM r JOIN e USING (session, tool) WHERE e.k = r.k + 1)),
w AS (SELECT max(epoch_ms(ts)) - 600000 AS mark FROM events)
SELECT session, tool, start_id, end_id, CASE WHEN end_id % 3 = 1 THEN 'done' ELSE 'error' END AS status FROM r, w WHERE end_id IS NOT NULL AND (end_ms // 600000 + 1) * 600000 <= mark
UNION ALL SELECT session, tool, event_id, NULL, 'unfinished' FROM e, w WHERE event_id % 3 = 0 AND event_id NOT IN (SELECT start_id FROM r WHERE start_id IS NOT NULL) AND ((ms + 3600000) // 600000 + 1) * 600000 <= mark"""


@query("st_tool_trace_stream", STREAMED)
def st_tool_trace_stream(m: Model) -> DataFrame:
    """The stream over the whole table of events, read back from its sink."""
    arriving = Model(m.spark, m.dir)
    arriving.table = lambda name: m.spark.readStream.schema(m.table(name).schema).parquet(f"{m.dir}/{name[:-1]}[s].parquet")
    return st.run_to_end(st.stream_traces(events(arriving)), scratch_folder(m.spark, "traces")).select("session", "tool", "start_id", "end_id", "status")


RECENT = "SELECT user_id::VARCHAR AS session, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100"


@query("st_recent_events", RECENT)
def st_recent_events(m: Model) -> DataFrame:
    return st.recent(events(m)).select("session", "event_id")


@query("st_recent_events_stream", RECENT)
def st_recent_events_stream(m: Model) -> DataFrame:
    """The same kept up by a stream of the table's files, read back from its store."""
    store = scratch_folder(m.spark, "recent")
    arriving = Model(m.spark, m.dir)
    arriving.table = lambda name: m.spark.readStream.schema(m.table(name).schema).option("maxFilesPerTrigger", 64).parquet(f"{m.dir}/{name[:-1]}[s].parquet")
    return st.recent_stream(events(arriving), store).select("session", "event_id")


@query("st_trace_summary", """WITH s AS (SELECT doc_id, source, length(coalesce(text, '')) AS n, len(string_split(coalesce(text, ''), ' ')) AS w, doc_id % 8 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN (w % 5 + n % 4) || ' chunks · 2 documents' WHEN 1 THEN (2 + w % 6) || ' nodes' WHEN 2 THEN (w % 7 + 1) || ' links' WHEN 3 THEN 'lines ' || n || '–' || (n + w) WHEN 4 THEN '+' || (w % 4) || ' −' || (n % 3) WHEN 5 THEN CASE WHEN n % 2 = 0 THEN 'abstained' ELSE (w % 3) || ' citations' END END AS badge FROM s""")
def st_trace_summary(m: Model) -> DataFrame:
    """Results of all tools as JSON texts, nested and sized by the documents, one of them an error and one broken."""
    text = F.coalesce("raw_text", F.lit(""))
    n, w = F.char_length(text), F.size(F.split(text, " "))
    some = lambda k, item: F.transform(F.slice(F.sequence(F.lit(1), F.lit(10)), 1, k), lambda i: item(i))
    path = lambda i: F.struct(F.concat("doc_slug", F.lit(".s_"), i.cast("string")).alias("path"))
    group = lambda slug, k: F.struct(slug.alias("doc_slug"), some(k, path).alias("chunks"))
    results = [
        F.to_json(F.struct(F.array(group(F.col("doc_slug"), w % 5), group(F.lit("other"), n % 4)).alias("groups"))),
        F.to_json(F.struct(F.array(F.struct(F.col("doc_slug").alias("path"), some(w % 6, path).alias("children")), F.struct(F.lit("x").alias("path"), some(F.lit(0), path).alias("children"))).alias("nodes"))),
        F.to_json(F.struct(F.array(F.struct(some(w % 7, lambda i: i.cast("string")).alias("targets")), F.struct(F.array("doc_slug").alias("targets"))).alias("steps"))),
        F.to_json(F.struct(n.alias("start_line"), (n + w).alias("end_line"), text.alias("text"))),
        F.to_json(F.struct(some(w % 4, path).alias("added"), some(n % 3, path).alias("removed"))),
        F.to_json(F.struct((n % 2 == 0).alias("abstained"), some(w % 3, path).alias("citations"))),
        F.to_json(F.struct(F.lit("no").alias("error"))), F.concat(F.lit('{"groups": ['), F.col("doc_slug")),
    ]
    tools = ["search", "navigate", "graph", "raw", "curate", "answer", "search", "search"]
    k = (F.col("doc_id") % 8 + 1).cast("int")
    rows = m.docs.select("doc_id", F.element_at(F.array(*[F.lit(t) for t in tools]), k).alias("tool"), F.element_at(F.array(*results), k).alias("result"))
    return rows.select("doc_id", st.badge().alias("badge"))


@query("st_incremental_ingest", f"WITH {C} SELECT path, verbatim_text, contextualized_text, start_line, end_line, doc_id % 7 = 3 AS quarantined FROM (SELECT path, verbatim_text, contextualized_text, start_line, end_line, doc_id FROM c WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_slug, NULL, NULL, NULL, NULL, doc_id FROM d WHERE doc_id % 7 = 3 AND raw_text IS NOT NULL)")
def st_incremental_ingest(m: Model) -> DataFrame:
    """The documents as a stream of files, cut into chunks and taken into a store; documents of some ids have no profile. Chunks, and documents in quarantine."""
    root = scratch_folder(m.spark, "ingest")
    arriving = m.spark.readStream.schema(m.table("documents").schema).option("maxFilesPerTrigger", 64).parquet(f"{m.dir}/document[s].parquet").where("text is not null")

    def cut(docs: DataFrame) -> DataFrame:
        lines = ch.lines_of(docs).where(F.col("line").rlike(r"\S"))
        head = F.concat(F.lit("["), F.replace("doc_slug", F.lit(".doc_"), F.lit(" > doc_")), F.lit("]\n"))
        return lines.select("doc_slug", F.concat("doc_slug", F.lit(".s_"), F.col("n").cast("string")).alias("path"), F.col("line").alias("verbatim_text"), F.concat(head, "line").alias("contextualized_text"), F.col("n").alias("start_line"), F.col("n").alias("end_line"), F.lit("SECTION").alias("node_type"))

    profiles = plugins.Profiles()
    profiles.register(plugins.Profile("lines", lambda file, text: file.endswith(".md"), cut))
    k = F.col("doc_id")
    docs = arriving.select(F.concat(k.cast("string"), F.when(k % 7 == 3, ".bin").otherwise(".md")).alias("file"), F.concat("source", F.lit(".doc_"), k.cast("string")).alias("doc_slug"), F.col("text").alias("raw_text"))
    version = ing.ingest_stream(docs, profiles, f"{root}/store", f"{root}/state")
    t = ing.read_store(m.spark, f"{root}/store", version)
    texts = ["path", "verbatim_text", "contextualized_text", "start_line", "end_line"]
    none = [F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")]
    bad = t["quarantine"].select(F.col("doc_slug").alias("path"), *[x.alias(c) for x, c in zip(none, texts[1:], strict=True)], F.lit(True).alias("quarantined"))
    return t["chunks"].select(*texts, F.lit(False).alias("quarantined")).unionByName(bad)


@query("ux_profile", f"WITH {C} SELECT profile, count(*) AS chunks FROM (SELECT CASE WHEN source IN ('src1', 'src2') THEN 'a' ELSE 'b' END AS profile FROM c) GROUP BY profile")
def ux_profile(m: Model) -> DataFrame:
    """Two profiles over all documents, told apart by the folder of the file; both cut at lines."""
    def cut(docs: DataFrame) -> DataFrame:
        return ch.lines_of(docs).where(F.col("line").rlike(r"\S"))

    own = plugins.Profiles()
    own.register(plugins.Profile("a", lambda file, text: file.rlike("/src[12]/"), cut))
    own.register(plugins.Profile("b", lambda file, text: file.isNotNull(), cut))
    docs = m.docs.select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("file"), "doc_slug", "raw_text")
    return own.chunk(docs)[0].groupBy("profile").agg(F.count("*").alias("chunks"))


@query("ux_profile_table", f"WITH {C} SELECT path, verbatim_text, start_line, end_line FROM c")
def ux_profile_table(m: Model) -> DataFrame:
    """A profile of the user's own as a Python table function: one chunk a line with text."""
    def cut(slug: str, text: str):
        for n, line in enumerate(text.split("\n"), 1):
            if line.strip(" \t\r\x0b\x0c"):
                yield f"{slug}.s_{n}", line, f"[{slug}]\n{line}", n, n, "SECTION"

    own = plugins.Profiles()
    own.register(plugins.table_profile("lines", lambda file, text: file.isNotNull(), cut))
    docs = m.docs.select(F.col("doc_id").cast("string").alias("file"), "doc_slug", "raw_text")
    return own.chunk(docs)[0].select("path", "verbatim_text", "start_line", "end_line")


@query("ux_encoder", f"WITH {C} SELECT path, round(CAST(CAST(n / sqrt(n * n + w * w) AS FLOAT) AS DOUBLE), 4) AS first FROM (SELECT path, length(verbatim_text)::DOUBLE AS n, (1 + length(verbatim_text) - length(replace(verbatim_text, ' ', '')))::DOUBLE AS w FROM c)")
def ux_encoder(m: Model) -> DataFrame:
    """An encoder of the user's own: two features of each text."""
    def make(dims: int):
        return lambda texts: np.array([[len(t), 1 + t.count(" ")] for t in texts], np.float64)

    e = ing.embed(m.chunks, "verbatim_text", 2, make)
    return e.select("path", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"))


@query("ux_reranker", f"{BASE}, sh AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY length(verbatim_text), rank) AS new_rank FROM rrf JOIN c USING (path) WHERE rank <= 10) SELECT query_id, path, new_rank FROM sh")
def ux_reranker(m: Model) -> DataFrame:
    """Hybrid hits reordered by a pair scorer of the user's own: short texts first."""
    scorer = plugins.pair_scorer(lambda q, t: np.array([-float(len(x)) for x in t]))
    hits = se.with_texts(hybrid(m), m.chunks.select("path", "verbatim_text")).join(m.search_queries.select("query_id", "query_text"), "query_id")
    return se.rerank(hits, scorer, 10).select("query_id", "path", "new_rank")


@query("ux_answer_rules", "SELECT conv_id * 10 + turn AS answer_id, 'NO_MARKER' AS code FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 9 IN (5, 8) AND NOT contains(CASE WHEN (conv_id + turn) % 9 = 5 THEN '' ELSE substr(text, 1, 20) END, '[#')")
def ux_answer_rules(m: Model) -> DataFrame:
    rule = plugins.answer_rule("NO_MARKER", ~F.contains("answer", F.lit("[#")))
    return an.violations(answers(m), m.chunks, [rule]).where("code = 'NO_MARKER'").select("answer_id", "code")


@query("sink_eval_cases", "SELECT CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS test_set, count(*) AS n FROM benchmark GROUP BY 1")
def sink_eval_cases(m: Model) -> DataFrame:
    out = scratch_folder(m.spark, "cases")
    corpus.write_cases(m.table("benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test").alias("test_set"), F.col("text").alias("query")), out)
    return m.spark.read.json(out).groupBy("test_set").agg(F.count("*").alias("n"))


@query("sink_snapshot", f"WITH {C} SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM c) AS chunks")
def sink_snapshot(m: Model) -> DataFrame:
    """Documents, chunks and edges written, restored into a store, and counted there."""
    out = scratch_folder(m.spark, "snapshot")
    corpus.write_snapshot({"documents": m.docs, "chunks": m.chunks, "graph_edges": m.edges}, f"{out}/dump")
    corpus.restore_snapshot(m.spark, f"{out}/dump", f"{out}/store")
    t = corpus.read_snapshot(m.spark, f"{out}/store")
    return t["documents"].agg(F.count("*").alias("documents")).join(t["chunks"].agg(F.count("*").alias("chunks")))


@query("src_corpus_files", "SELECT source, count(*) AS n_lines, CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source")
def src_corpus_files(m: Model) -> DataFrame:
    """All lines of the documents written to Markdown files, one folder a source, beside hidden files, and read back as a corpus of files."""
    out = scratch_folder(m.spark, "files")
    lines = m.docs.where("raw_text is not null").select("source", F.explode(F.split("raw_text", "\n")).alias("line"))
    corpus.write_files(lines, f"{out}/corpus", "source")
    corpus.write_files(lines.limit(1), f"{out}/corpus/.hidden", "source")
    back = corpus.corpus_files(m.spark, f"{out}/corpus", "ns")
    source = corpus.folder_value(F.col("file"), "source")
    return back.groupBy(source.alias("source")).agg(F.sum(F.size(F.split("raw_text", "\n")) - 1).alias("n_lines"), F.sum(F.length("raw_text")).alias("chars"))


@query("src_benchmark_payloads", "SELECT lpad((item_id % 7)::VARCHAR, 2, '0') AS batch, item_id AS id, text AS query, 'search' AS tool_name FROM benchmark")
def src_benchmark_payloads(m: Model) -> DataFrame:
    """Payloads in seven files of one JSON array each, named by their batch, and read back."""
    out = scratch_folder(m.spark, "payloads")
    item = F.struct(F.col("item_id").alias("id"), F.lit("search").alias("tool_name"), F.struct(F.col("text").alias("query")).alias("arguments"))
    files = m.table("benchmark").groupBy(F.format_string("batch_%02d", F.col("item_id") % 7).alias("file")).agg(F.to_json(F.collect_list(item)).alias("value"))
    files.repartition(1).write.partitionBy("file").text(f"{out}/raw")
    fs_path = m.spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(out).getFileSystem(m.spark._jsc.hadoopConfiguration())
    for k in range(7):  # Spark names files itself
        for part in fs.globStatus(fs_path(f"{out}/raw/file=batch_{k:02d}/part-*")) or []:
            fs.mkdirs(fs_path(f"{out}/batches"))
            fs.rename(part.getPath(), fs_path(f"{out}/batches/batch_{k:02d}.json"))
    return corpus.read_payloads(m.spark, f"{out}/batches").select("batch", "id", F.col("arguments")["query"].alias("query"), "tool_name")
