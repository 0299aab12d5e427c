"""Validation, text and merge queries over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.functions import text as tx
from treelark.operators import ingest as ing
from treelark.operators import validate as val
from treelark.plans.model import EDGES, C, D, Model
from treelark.plans.registry import query
from treelark.sources.scratch import scratch_folder

NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def damaged(m: Model) -> DataFrame:
    """The chunks, some of them broken by rule."""
    c, n = m.chunks, F.pmod(F.col("doc_id") + F.col("start_line"), F.lit(40))
    path = F.when(n == 1, F.concat(F.lit("other."), "path")).when(n == 2, F.concat("path", F.lit("-"))).when(n == 3, F.concat("doc_slug", F.lit(".twin"))).otherwise(F.col("path"))
    return c.select(
        "doc_slug", path.alias("path"), F.when(n == 4, " ").otherwise(F.col("verbatim_text")).alias("verbatim_text"), F.when(n == 5, F.concat("contextualized_text", F.lit("?"))).otherwise(F.when(n == 4, " ").otherwise(F.col("contextualized_text"))).alias("contextualized_text"),
        F.when(n == 6, F.col("start_line") - 1).otherwise(F.col("start_line")).alias("start_line"), F.when(n == 7, F.col("end_line") + 500).otherwise(F.col("end_line")).alias("end_line"),
    )


@query(
    "val_chunks",
    f"""WITH {C}, b AS (SELECT doc_slug, (doc_id + start_line) % 40 AS k, CASE (doc_id + start_line) % 40 WHEN 1 THEN 'other.' || path WHEN 2 THEN path || '-' WHEN 3 THEN doc_slug || '.twin' ELSE path END AS path,
 CASE (doc_id + start_line) % 40 WHEN 6 THEN start_line - 1 ELSE start_line END AS s, CASE (doc_id + start_line) % 40 WHEN 7 THEN end_line + 500 ELSE end_line END AS e FROM c),
 r AS (SELECT b.*, len(string_split(raw_text, chr(10))) AS total, max(e) OVER (PARTITION BY b.doc_slug ORDER BY s, e, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, count(*) OVER (PARTITION BY path) AS copies FROM b JOIN d ON d.doc_slug = b.doc_slug),
 v AS (SELECT doc_slug, path, unnest(list_filter([CASE WHEN k = 2 THEN 'INVALID_PATH' END, CASE WHEN k = 1 THEN 'NAMESPACE_ESCAPE' END, CASE WHEN copies > 1 THEN 'DUPLICATE_PATH' END, CASE WHEN k = 4 THEN 'EMPTY_VERBATIM' END, CASE WHEN k = 5 THEN 'CONTEXT_MISMATCH' END,
 CASE WHEN s < 1 OR e < s OR e > total THEN 'OUT_OF_BOUNDS' END, CASE WHEN s <= reach THEN 'OVERLAP' END], lambda x: x IS NOT NULL)) AS rule FROM r) SELECT * FROM v""",
)
def val_chunks(m: Model) -> DataFrame:
    return val.chunk_violations(damaged(m), m.docs)


@query("txt_split_context", f"WITH {C} SELECT path, CASE WHEN start_line % 3 = 0 THEN '' ELSE source || ' > doc_' || doc_id END AS breadcrumb, verbatim_text AS text FROM c")
def txt_split_context(m: Model) -> DataFrame:
    context = F.when(F.col("start_line") % 3 == 0, F.col("verbatim_text")).otherwise(F.col("contextualized_text"))
    s = tx.split_context(context, F.col("verbatim_text"))
    return m.chunks.select("path", s["breadcrumb"].alias("breadcrumb"), s["text"].alias("text"))


@query("txt_normalise_ws", f"WITH {D} SELECT doc_slug, {NORM.format('raw_text')} AS text FROM d")
def txt_normalise_ws(m: Model) -> DataFrame:
    return m.docs.select("doc_slug", tx.normalise_ws(F.col("raw_text")).alias("text"))


@query("txt_find_span", f"WITH {D}, w AS (SELECT doc_slug, raw_text, regexp_extract(raw_text, '\\S+\\s+\\S+\\s+\\S+') AS quote FROM d) SELECT doc_slug, strpos(raw_text, quote) - 1 AS start, strpos(raw_text, quote) - 1 + length(quote) AS \"end\" FROM w WHERE quote <> ''")
def txt_find_span(m: Model) -> DataFrame:
    """The first three words of each document, looked up with single spaces between them."""
    q = m.docs.select("doc_slug", "raw_text", F.regexp_extract("raw_text", r"\S+\s+\S+\s+\S+", 0).alias("q")).where("q <> ''")
    s = tx.find_span(F.col("raw_text"), F.regexp_replace("q", r"\s+", " "))
    return q.select("doc_slug", s["start"].alias("start"), s["end"].alias("end"))


def old_docs(m: Model) -> DataFrame:
    return m.docs.where("doc_id % 3 <> 0").select("doc_slug", F.md5("doc_slug").alias("id"), "title", F.lit(1).alias("version"), F.lit("2020-01-01").alias("created_at"))


def new_docs(m: Model) -> DataFrame:
    return m.docs.where("doc_id % 3 <> 1").select("doc_slug", F.concat(F.lit("n"), F.md5("doc_slug")).alias("id"), F.concat(F.lit("* "), "title").alias("title"), F.lit(2).alias("version"), F.lit("2021-01-01").alias("created_at"))


@query("ing_upsert_docs", f"WITH {D} SELECT doc_slug, CASE WHEN doc_id % 3 = 0 THEN 'n' || md5(doc_slug) ELSE md5(doc_slug) END AS id, CASE WHEN doc_id % 3 = 1 THEN title ELSE '* ' || title END AS title, CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 2 END AS version, CASE WHEN doc_id % 3 = 0 THEN '2021-01-01' ELSE '2020-01-01' END AS created_at FROM d")
def ing_upsert_docs(m: Model) -> DataFrame:
    return ing.upsert(old_docs(m), new_docs(m), "doc_slug")


STORED = "st AS (SELECT path, CASE WHEN start_line % 4 = 1 THEN contextualized_text || '!' ELSE contextualized_text END AS txt, CASE WHEN start_line % 5 = 0 THEN NULL ELSE [start_line::FLOAT, doc_id::FLOAT] END AS embedding, doc_id, start_line FROM c WHERE doc_id % 2 = 0)"


def stored(m: Model) -> DataFrame:
    n = F.col("start_line")
    text = F.when(n % 4 == 1, F.concat("contextualized_text", F.lit("!"))).otherwise(F.col("contextualized_text"))
    return m.chunks.where("doc_id % 2 = 0").select("doc_slug", "path", text.alias("contextualized_text"), F.when(n % 5 != 0, F.array(n.cast("float"), F.col("doc_id").cast("float"))).alias("embedding"), "doc_id", "start_line")


@query("ing_upsert_chunks", f"WITH {C}, {STORED} SELECT c.path, c.contextualized_text, st.embedding[1] AS e1 FROM c LEFT JOIN st ON st.path = c.path")
def ing_upsert_chunks(m: Model) -> DataFrame:
    old = stored(m).select("path", "contextualized_text", "embedding")
    new = m.chunks.select("path", "contextualized_text", F.lit(None).cast("array<float>").alias("embedding"))
    return ing.upsert(old, new, "path", (), ("embedding",)).select("path", "contextualized_text", F.get("embedding", F.lit(0)).alias("e1"))


@query("ing_embedding_reuse", f"WITH {C}, {STORED} SELECT c.path, coalesce(st.txt = c.contextualized_text AND st.embedding IS NOT NULL, false) = false AS needs_embedding FROM c LEFT JOIN st ON st.path = c.path")
def ing_embedding_reuse(m: Model) -> DataFrame:
    return ing.split_by_reuse(m.chunks, stored(m)).select("path", "needs_embedding")


@query("ing_delete_stale", f"WITH {C}, {EDGES}, keep AS (SELECT path FROM c WHERE doc_id % 2 = 1 OR start_line % 2 = 1), ed AS (SELECT doc_slug || '.s_1' AS source, doc_slug || '.s_2' AS target FROM d) SELECT (SELECT count(*) FROM keep) AS chunks, (SELECT count(*) FROM ed WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path IN (ed.source, ed.target) AND doc_id % 2 = 0 AND start_line % 2 = 0)) AS edges")
def ing_delete_stale(m: Model) -> DataFrame:
    c = m.chunks
    edges = m.docs.select(F.concat("doc_slug", F.lit(".s_1")).alias("source"), F.concat("doc_slug", F.lit(".s_2")).alias("target"))
    chunks, left = ing.delete_stale(c, c.where("doc_id % 2 = 0 and start_line % 2 = 1"), edges)
    return chunks.agg(F.count("*").alias("chunks")).join(left.agg(F.count("*").alias("edges")))


@query("ing_skip_existing", f"WITH {C} SELECT d.doc_slug, count(c.path) AS stored_chunks FROM d LEFT JOIN c ON c.doc_slug = d.doc_slug WHERE d.doc_id % 3 <> 0 GROUP BY ALL")
def ing_skip_existing(m: Model) -> DataFrame:
    return ing.skip_existing(m.docs, m.docs.where("doc_id % 3 <> 0"), m.chunks)[1]


DRAFTS = "dr AS (SELECT doc_slug || '.s_1' AS source_path, CASE doc_id % 3 WHEN 0 THEN doc_slug || '.s_2' WHEN 1 THEN 'no.such' ELSE doc_slug || '.s_1' END AS target_path FROM d)"


@query("ing_resolve_edges", f"WITH {C}, {DRAFTS} SELECT source_path, target_path, md5(source_path) AS source, md5(target_path) AS target FROM dr WHERE source_path <> target_path AND source_path IN (SELECT path FROM c) AND target_path IN (SELECT path FROM c)")
def ing_resolve_edges(m: Model) -> DataFrame:
    k, slug = F.col("doc_id"), F.col("doc_slug")
    target = F.when(k % 3 == 0, F.concat(slug, F.lit(".s_2"))).when(k % 3 == 1, "no.such").otherwise(F.concat(slug, F.lit(".s_1")))
    drafts = m.docs.select(F.concat(slug, F.lit(".s_1")).alias("source_path"), target.alias("target_path"))
    ids = m.chunks.select("path", F.md5("path").alias("id"), "doc_id")
    return ing.resolve_edges(drafts, ids.where("doc_id % 2 = 0"), ids.where("doc_id % 2 = 1")).select("source_path", "target_path", "source", "target")


@query("ing_upsert_edges", f"WITH {EDGES} SELECT source, target, relation_type, CASE WHEN source % 2 = 0 THEN 'new' WHEN source % 3 = 0 THEN 'first' ELSE citation_text END AS citation_text, CASE WHEN source % 2 = 0 THEN 'why' ELSE 'old' END AS rationale FROM edges")
def ing_upsert_edges(m: Model) -> DataFrame:
    """Even sources get a plain row, then one with a rationale; every third of the odd ones two plain rows; all get one of an unknown relation."""
    old = m.edges.withColumn("rationale", F.lit("old"))
    row = lambda df, seq, text, why, rel=None: df.select("source", "target", (F.lit(rel) if rel else F.col("relation_type")).alias("relation_type"), F.lit(text).alias("citation_text"), F.lit(why).cast("string").alias("rationale"), F.lit(seq).alias("seq"))
    even, odd = m.edges.where("source % 2 = 0"), m.edges.where("source % 2 = 1 and source % 3 = 0")
    incoming = row(even, 1, "plain", None).unionByName(row(even, 2, "new", "why")).unionByName(row(odd, 1, "first", None)).unionByName(row(odd, 2, "second", None)).unionByName(row(m.edges, 3, "x", "y", "LIKES"))
    return ing.upsert_edges(old, incoming, m.relations)[0]


@query("ing_summary", f"WITH {C}, {EDGES} SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM d WHERE doc_id % 3 = 0) AS skipped")
def ing_summary(m: Model) -> DataFrame:
    return ing.summary(m.docs, m.chunks, m.edges, m.docs.where("doc_id % 3 = 0"))


@query("ing_list_unembedded", f"WITH {C}, {STORED} SELECT path FROM st WHERE embedding IS NULL ORDER BY doc_id, path LIMIT 100")
def ing_list_unembedded(m: Model) -> DataFrame:
    """The hundred oldest; doc_id stands for the time of creation."""
    return ing.unembedded(stored(m).withColumn("created_at", F.col("doc_id")), 100).select("path")


@query("ing_embed_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda x: x * x))), 6) AS length16, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda x: x * x))), 6) AS first FROM embeddings")
def ing_embed_normalise(m: Model) -> DataFrame:
    v = ing.normalise(F.col("embedding"), 16)
    return m.table("embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(F.slice("embedding", 1, 16), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 6).alias("length16"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


BITS = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
CRC_TABLE = f"list_transform(range(0, 256), lambda v: list_reduce(list_concat([v::BIGINT], range(0, 8)), lambda c, k: {BITS}))"
HEX = "strpos('0123456789ABCDEF', substr(x, 2 * i + {k}, 1)) - 1"
EMBED = f"""WITH {C}, w AS (SELECT path, unnest(list_filter(regexp_split_to_array(lower(contextualized_text), '\\s+'), lambda t: t <> '')) AS w FROM c), dw AS (SELECT DISTINCT w FROM w),
x AS (SELECT w, hex(encode(w)) AS x, {CRC_TABLE} AS crc_table FROM dw), b AS (SELECT w, crc_table, list_transform(range(0, len(x) // 2), lambda i: (({HEX.format(k=1)}) * 16 + {HEX.format(k=2)})::BIGINT) AS bs FROM x),
h AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], bs), lambda c, v: xor(crc_table[(xor(c, v) & 255) + 1], c // 256)), 4294967295::BIGINT) AS h FROM b),
dv AS (SELECT path, h % 64 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w JOIN h USING (w) GROUP BY ALL),
dn AS (SELECT path, k, v, sqrt(sum(v * v) OVER (PARTITION BY path)) AS size FROM dv)
SELECT path, 1.0::DOUBLE AS length2, round(sum((k + 1) * (v / size)::FLOAT::DOUBLE), 3) AS digest FROM dn WHERE size > 0 GROUP BY path"""


@query("ing_embed", EMBED)
def ing_embed(m: Model) -> DataFrame:
    """All chunks embedded by the default encoder: that vectors are units, and a weighted sum of their components. Vectors of zeros are left out."""
    e = ing.embed(m.chunks.select("path", "contextualized_text"))
    length2 = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4)
    placed = F.aggregate(F.transform("embedding", lambda x, k: (k + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.select("path", length2.alias("length2"), F.round(placed, 3).alias("digest")).where("length2 > 0")


@query("ing_namespace_prefix", f"WITH {D} SELECT doc_id, CASE WHEN source = 'src1' THEN doc_slug ELSE 'src1.' || doc_slug END AS doc_slug FROM d")
def ing_namespace_prefix(m: Model) -> DataFrame:
    return m.docs.select("doc_id", ing.with_namespace(F.col("doc_slug"), "src1").alias("doc_slug"))


@query("ing_backfill_citation", f"WITH {C}, ed AS (SELECT doc_slug || '.s_1' AS source, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'said' END AS citation_text FROM d) SELECT ed.source, coalesce(nullif(trim(citation_text), ''), verbatim_text) AS citation_text FROM ed LEFT JOIN c ON path = ed.source")
def ing_backfill_citation(m: Model) -> DataFrame:
    k = F.col("doc_id") % 3
    edges = m.docs.select(F.concat("doc_slug", F.lit(".s_1")).alias("source"), F.when(k == 0, F.lit(None)).when(k == 1, " ").otherwise("said").alias("citation_text"))
    return ing.backfill_citations(edges, m.chunks)


def cut_lines(docs: DataFrame) -> DataFrame:
    """A profile of one chunk a non-blank line."""
    lines = docs.select("doc_slug", F.posexplode(F.split("raw_text", "\n")).alias("k", "line")).where(F.col("line").rlike(r"\S"))
    n = (F.col("k") + 1).cast("long")
    context = F.concat(F.lit("["), "doc_slug", F.lit("]\n"), "line")
    return lines.select("doc_slug", F.concat("doc_slug", F.lit(".s_"), n.cast("string")).alias("path"), F.col("line").alias("verbatim_text"), context.alias("contextualized_text"), n.alias("start_line"), n.alias("end_line"), F.lit("SECTION").alias("node_type"))


JOB = f"""WITH {C}, nb AS (SELECT d.doc_id, count(c.path) AS n FROM d LEFT JOIN c ON c.doc_id = d.doc_id WHERE raw_text IS NOT NULL GROUP BY d.doc_id), bad AS (SELECT doc_id, doc_id % 7 = 3 OR (doc_id % 11 = 5 AND n >= CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) AS bad FROM nb), kept AS (SELECT * FROM c WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 5), lined2 AS (SELECT doc_id, start_line FROM kept), gone AS (SELECT doc_id, max(start_line) AS last FROM kept WHERE doc_id % 2 = 0 GROUP BY doc_id)
 SELECT (SELECT count(*) FROM bad WHERE NOT bad) AS documents, (SELECT count(*) FROM lined2) - (SELECT count(*) FROM gone) AS chunks,
 (SELECT count(*) FROM lined2 a JOIN lined2 b ON b.doc_id = a.doc_id AND b.start_line = 2 WHERE a.start_line = 1 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.last IN (1, 2))) AS edges,
 (SELECT count(*) FROM lined2 l WHERE doc_id % 2 = 0 AND start_line = 1 AND start_line < (SELECT last FROM gone g WHERE g.doc_id = l.doc_id)) AS embedded, 0 AS skipped, (SELECT count(*) FROM bad WHERE bad) AS quarantined"""


@query("ing_job", JOB)
def ing_job(m: Model) -> DataFrame:
    """All documents into an empty store, and those of even ids again, without their last line with text and with another first line.

    Documents of some ids have no profile, others a chunk out of its namespace: both are in quarantine.
    """
    from treelark import plugins

    def escaping(docs: DataFrame) -> DataFrame:
        return cut_lines(docs).withColumn("path", F.concat(F.lit("elsewhere."), "path"))

    profiles = plugins.Profiles()
    profiles.register(plugins.Profile("lines", lambda file, text: file.endswith(".md"), cut_lines))
    profiles.register(plugins.Profile("escaping", lambda file, text: file.endswith(".esc"), escaping))
    k = F.col("doc_id")
    suffix = F.when(k % 7 == 3, ".bin").when(k % 11 == 5, ".esc").otherwise(".md")
    docs = m.docs.where("raw_text is not null").select("doc_id", F.concat(F.lit("/corpus/"), k.cast("string"), suffix).alias("file"), "doc_slug", "raw_text")
    columns, store = ["file", "doc_slug", "raw_text"], scratch_folder(m.spark, "store")
    s = F.col("doc_slug")
    drafts = docs.select(F.concat(s, F.lit(".s_1")).alias("source_path"), F.concat(s, F.lit(".s_2")).alias("target_path"), F.lit("SUPPORTS").alias("relation_type"), F.lit("said").alias("citation_text"), F.lit(None).cast("string").alias("rationale"), F.lit(1).alias("seq"))
    ing.ingest_documents(docs.select(*columns), profiles, store, 0, drafts, m.relations)
    lines = F.split("raw_text", "\n")
    last = F.array_max(F.transform(lines, lambda t, i: F.when(t.rlike(r"\S"), i)))
    changed = F.transform(lines, lambda t, i: F.when(i == last, "").when((i == 0) & t.rlike(r"\S"), F.concat(t, F.lit(" more"))).otherwise(t))
    again = docs.where(k % 2 == 0).withColumn("raw_text", F.array_join(changed, "\n"))
    return ing.ingest_documents(again.select(*columns), profiles, store, 1)
