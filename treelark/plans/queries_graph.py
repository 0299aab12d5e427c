"""Knowledge graph and grounded-answer queries over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.operators import answers as an
from treelark.operators import graph as kg
from treelark.plans.model import EDGES, SYMMETRIC, C, Model
from treelark.plans.registry import query
from treelark.sources.scratch import saved

_SYM = ", ".join(f"'{c}'" for c in SYMMETRIC)
STEPS = f"""WITH RECURSIVE {EDGES}, e AS (SELECT *, md5(source || '|' || target || '|' || relation_type) AS edge_id FROM edges),
st AS (SELECT edge_id, source AS f, target AS t, relation_type, citation_text FROM e UNION ALL SELECT edge_id, target, source, relation_type, citation_text FROM e WHERE relation_type IN ({_SYM})),
w AS (SELECT source AS source0, edge_id, f, t, relation_type, citation_text, 1 AS depth, [source, t] AS visited FROM (SELECT DISTINCT source FROM edges) s JOIN st ON f = source WHERE t <> source
 UNION ALL SELECT source0, st.edge_id, st.f, st.t, st.relation_type, st.citation_text, depth + 1, list_append(visited, st.t) FROM w JOIN st ON st.f = w.t WHERE depth < 2 AND NOT list_contains(visited, st.t)),
dd AS (SELECT source0, edge_id, f AS "from", t AS "to", relation_type, citation_text, min(depth) AS depth FROM w GROUP BY ALL)"""


def steps(m: Model) -> DataFrame:
    """Walks of up to two steps from every source of an edge. Steps carry the digest of a citation, which tells texts apart as well: no query shows the text."""
    edges = saved(m.edges.withColumn("citation_text", F.sha2("citation_text", 256)), "edges")
    return kg.walk(edges.select("source").distinct(), edges, m.relations, 2)


@query("kg_traverse", f'{STEPS} SELECT source0, edge_id, f AS "from", t AS "to", relation_type, depth, count(*) AS walks FROM w GROUP BY ALL')
def kg_traverse(m: Model) -> DataFrame:
    return steps(m).groupBy("source0", "edge_id", "from", "to", "relation_type", "depth").agg(F.sum("walks").alias("walks"))


@query("kg_step_dedupe", f'{STEPS} SELECT source0, edge_id, "from", "to", depth, nth FROM (SELECT *, row_number() OVER (PARTITION BY source0 ORDER BY depth, relation_type, "to", "from", edge_id) AS nth FROM dd) WHERE nth <= 20')
def kg_step_dedupe(m: Model) -> DataFrame:
    return kg.step_dedupe(steps(m), 20).select("source0", "edge_id", "from", "to", "depth", "nth")


@query("kg_links", f'{STEPS} SELECT source0, "from", "to", relation_type, depth, total, place, total > 2 AS truncated FROM (SELECT *, count(*) OVER p AS total, row_number() OVER (p ORDER BY "to", edge_id) AS place FROM dd WINDOW p AS (PARTITION BY source0, "from", relation_type, citation_text, depth)) WHERE place <= 2')
def kg_links(m: Model) -> DataFrame:
    return kg.links(kg.step_dedupe(steps(m)), 2).select("source0", "from", "to", "relation_type", "depth", "total", "place", "truncated")


@query("kg_doc_graph", f"""WITH {EDGES}, n AS (SELECT doc_id AS id, lang FROM documents), o AS (SELECT e.*, t.id IS NULL AS ext FROM edges e JOIN n s ON s.id = source LEFT JOIN n t ON t.id = target AND t.lang = s.lang)
 SELECT id, (SELECT count(*) FROM o WHERE target = id AND NOT ext) AS in_degree, (SELECT count(*) FROM o WHERE source = id) AS out_degree, (SELECT count(*) FROM o WHERE source = id AND ext) AS external FROM n""")
def kg_doc_graph(m: Model) -> DataFrame:
    """The graph of each language's documents."""
    return kg.doc_graph(m.docs.select(F.col("doc_id").alias("id"), "lang"), m.edges, "lang").drop("lang")


@query("kg_list_edges", f"WITH {EDGES} SELECT source, target, relation_type FROM edges WHERE source IN (SELECT doc_id FROM labels)")
def kg_list_edges(m: Model) -> DataFrame:
    return kg.list_edges(m.table("labels").select(F.col("doc_id").alias("source")), m.edges).select("source", "target", "relation_type")


@query("kg_find_edges", f"WITH {EDGES}, k AS (SELECT DISTINCT doc_id AS source, (doc_id * 7 + 3) % (SELECT max(doc_id) + 1 FROM documents) AS target, 'SEE_ALSO' AS relation_type FROM documents) SELECT source, target, relation_type FROM edges JOIN k USING (source, target, relation_type)")
def kg_find_edges(m: Model) -> DataFrame:
    top = m.docs.agg(F.max("doc_id").alias("top"))
    keys = m.docs.join(F.broadcast(top)).select(F.col("doc_id").alias("source"), F.pmod(F.col("doc_id") * 7 + 3, F.col("top") + 1).alias("target"), F.lit("SEE_ALSO").alias("relation_type"))
    return kg.find_edges(keys, m.edges).select("source", "target", "relation_type")


def proposals(m: Model) -> DataFrame:
    """One proposal a chunk, in batches by document; every rule is broken by some."""
    c = m.chunks
    k, n = F.col("doc_id"), F.col("start_line")
    kind = F.pmod(k * 5 + n, F.lit(60))
    target = F.when(kind == 1, "no.such").when(kind == 2, F.col("path")).otherwise(F.col("doc_slug"))
    quote = F.when(kind == 3, " ").when(kind == 4, "never said").otherwise(F.col("verbatim_text"))
    return c.select(
        k.alias("batch_id"), n.alias("seq"), F.when(kind == 5, "no.source").otherwise(F.col("path")).alias("source"), target.alias("target"),
        F.when(kind == 6, "LIKES").otherwise("SUPPORTS").alias("relation_type"), quote.alias("citation_text"), F.when(kind == 7, "").otherwise("because").alias("reason"),
    )


PROPOSALS = """pr AS (SELECT doc_id AS batch_id, start_line AS seq, CASE WHEN kind = 5 THEN 'no.source' ELSE path END AS source, path AS own, verbatim_text, doc_slug,
 CASE kind WHEN 1 THEN 'no.such' WHEN 2 THEN path ELSE doc_slug END AS target, CASE kind WHEN 6 THEN 'LIKES' ELSE 'SUPPORTS' END AS relation_type, CASE kind WHEN 3 THEN ' ' WHEN 4 THEN 'never said' ELSE verbatim_text END AS citation_text, kind
 FROM (SELECT *, (doc_id * 5 + start_line) % 60 AS kind FROM c)),
norm AS (SELECT *, trim(regexp_replace(citation_text, '\\s+', ' ', 'g')) AS nq, trim(regexp_replace(verbatim_text, '\\s+', ' ', 'g')) AS nt FROM pr),
va AS (SELECT *, CASE WHEN kind = 7 THEN 'MISSING_REASON' WHEN kind = 6 THEN 'INVALID_RELATION_TYPE' WHEN kind = 5 THEN 'SOURCE_NOT_FOUND' WHEN kind = 1 THEN 'TARGET_NOT_FOUND' WHEN trim(citation_text) = '' THEN 'EMPTY_CITATION_TEXT'
 WHEN nq = '' OR NOT contains(nt, nq) THEN 'UNGROUNDED_CITATION_TEXT' WHEN source = target THEN 'SELF_REFERENCING_EDGE' END AS violation FROM norm),
ac AS (SELECT *, count(violation) OVER (PARTITION BY batch_id) = 0 AS accepted FROM va)"""


def checked(m: Model) -> DataFrame:
    return kg.validate_proposals(proposals(m), m.chunks.select("path", "verbatim_text"), m.relations)


@query("kg_validate_proposals", f"WITH {C}, {PROPOSALS} SELECT batch_id, seq, violation, accepted FROM ac")
def kg_validate_proposals(m: Model) -> DataFrame:
    return checked(m).select("batch_id", "seq", "violation", "accepted")


PLAN = "pl AS (SELECT ac.source, c.path AS target, relation_type, ac.citation_text FROM ac JOIN c ON c.doc_slug = ac.doc_slug AND c.path <> ac.source WHERE accepted)"


def planned(m: Model) -> DataFrame:
    texts = m.chunks.select("path", "verbatim_text")
    return kg.plan_additions(kg.accepted_proposals(proposals(m), texts, m.relations), texts)


@query("kg_plan_additions", f"WITH {C}, {PROPOSALS}, {PLAN} SELECT * FROM pl")
def kg_plan_additions(m: Model) -> DataFrame:
    return planned(m).select("source", "target", "relation_type", "citation_text")


def stored(plan: DataFrame) -> DataFrame:
    """Edges in the store: those planned from the odd lines."""
    return plan.where("seq % 2 = 1").select("source", "target", "relation_type", "citation_text")


ODD = "od AS (SELECT pl.* FROM pl JOIN c ON c.path = pl.source WHERE c.start_line % 2 = 1)"


@query("kg_insert_new", f"WITH {C}, {PROPOSALS}, {PLAN}, {ODD} SELECT pl.source, pl.target, od.source IS NOT NULL AS existing FROM pl LEFT JOIN od ON od.source = pl.source AND od.target = pl.target")
def kg_insert_new(m: Model) -> DataFrame:
    plan = planned(m)
    added, existing = kg.insert_new(plan, stored(plan))
    return added.select("source", "target", F.lit(False).alias("existing")).unionByName(existing.select("source", "target", F.lit(True).alias("existing")))


@query("kg_remove", f"WITH {EDGES}, k AS (SELECT source, target, relation_type FROM edges WHERE source % 3 = 0 UNION ALL SELECT doc_id, -1, 'SUPPORTS' FROM labels) SELECT (SELECT count(*) FROM edges WHERE source % 3 <> 0) AS kept, (SELECT count(*) FROM edges WHERE source % 3 = 0) AS removed, (SELECT count(DISTINCT doc_id) FROM labels) AS not_found")
def kg_remove(m: Model) -> DataFrame:
    e = m.edges
    gone = m.table("labels").select(F.col("doc_id").alias("source"), F.lit(-1).cast("long").alias("target"), F.lit("SUPPORTS").alias("relation_type"))
    left, removed, missing = kg.remove(e.where("source % 3 = 0").select(*kg.TRIPLE).unionByName(gone), e)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(left, "kept").join(n(removed, "removed")).join(n(missing, "not_found"))


@query("kg_delete_by", f"WITH {EDGES} SELECT count(*) FILTER (WHERE source IN (SELECT doc_id FROM labels) AND relation_type = 'SUPPORTS') AS deleted, count(*) FILTER (WHERE NOT (source IN (SELECT doc_id FROM labels) AND relation_type = 'SUPPORTS')) AS kept FROM edges")
def kg_delete_by(m: Model) -> DataFrame:
    left, deleted = kg.delete_by(m.edges, m.table("labels").select(F.col("doc_id").alias("source")), "SUPPORTS")
    return deleted.join(left.agg(F.count("*").alias("kept")))


@query("kg_audit_log", f"WITH {EDGES} SELECT CASE WHEN source % 2 = 0 THEN 'ADDED' ELSE 'REMOVED' END AS action, source, target, relation_type, 'curator' AS actor, 'review' AS reason FROM edges")
def kg_audit_log(m: Model) -> DataFrame:
    log = kg.audit_log(m.edges.where("source % 2 = 0"), m.edges.where("source % 2 = 1"), "curator", "review")
    return log.select("action", "source", "target", "relation_type", "actor", "reason")


def answers(m: Model) -> DataFrame:
    """One answer an assistant turn, citing chunks by rule; every rule is broken by some."""
    c = m.table("conversations").where("role = 'assistant'")
    k = F.col("conv_id") * 10 + F.col("turn")
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))
    slug = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"), F.lit(".doc_"), F.col("conv_id").cast("string"))
    path = F.when(kind == 1, "bad path!").when(kind == 2, "no.such").otherwise(F.concat(slug, F.lit(".s_1")))
    quote = F.when(kind == 3, F.lit(None)).when(kind == 4, "never said this").otherwise("")
    two = F.array(F.struct(F.concat(F.lit(" "), path).alias("path"), quote.alias("citation_text")), F.struct(F.concat(slug, F.lit(".s_1")).alias("path"), F.lit(None).cast("string").alias("citation_text")))
    text = F.when(kind == 5, " ").otherwise(F.concat(F.col("text"), F.when(kind == 6, " [#7]").when(kind == 8, "").otherwise(" [#2] and [#1]")))
    return c.select(k.alias("answer_id"), text.alias("answer"), (kind == 7).alias("abstained"), F.when(kind == 0, F.array().cast("array<struct<path:string,citation_text:string>>")).otherwise(two).alias("citations"))


ANSWERS = """a AS (SELECT conv_id * 10 + turn AS answer_id, (conv_id + turn) % 9 AS kind, 'src' || (conv_id % 20) || '.doc_' || conv_id || '.s_1' AS p, text FROM conversations WHERE role = 'assistant'),
a2 AS (SELECT *, CASE WHEN kind = 5 THEN ' ' ELSE text || CASE kind WHEN 6 THEN ' [#7]' WHEN 8 THEN '' ELSE ' [#2] and [#1]' END END AS answer, EXISTS (SELECT 1 FROM c WHERE c.path = p) AS there FROM a)"""


@query("ans_normalise_citations", f"WITH {C}, {ANSWERS} SELECT answer_id, CASE WHEN kind = 0 THEN 0 ELSE 2 END AS n, CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'bad path!' WHEN 2 THEN 'no.such' ELSE p END AS first_path FROM a2")
def ans_normalise_citations(m: Model) -> DataFrame:
    c = an.normalise_citations(F.col("citations"))
    return answers(m).select("answer_id", F.size(c).cast("long").alias("n"), F.get(c, F.lit(0))["path"].alias("first_path"))


@query(
    "ans_validate",
    f"""WITH {C}, {ANSWERS}, v AS (SELECT answer_id, 'EMPTY_ANSWER' AS code, NULL AS path FROM a2 WHERE kind = 5 UNION ALL SELECT answer_id, 'MISSING_CITATIONS', NULL FROM a2 WHERE kind = 0 UNION ALL SELECT answer_id, 'INVALID_LTREE_PATH', 'bad path!' FROM a2 WHERE kind = 1
 UNION ALL SELECT answer_id, 'DANGLING_CITATION_MARKER', '[#7]' FROM a2 WHERE kind = 6 UNION ALL SELECT answer_id, 'PATH_NOT_FOUND', 'no.such' FROM a2 WHERE kind = 2 UNION ALL SELECT answer_id, 'PATH_NOT_FOUND', p FROM a2 WHERE kind IN (2, 3, 4, 8) AND NOT there UNION ALL SELECT answer_id, 'PATH_NOT_FOUND', p FROM a2 WHERE kind IN (3, 4, 8) AND NOT there
 UNION ALL SELECT answer_id, 'MISSING_CITATION_TEXT', p FROM a2 WHERE kind IN (2, 3, 4, 8) AND there UNION ALL SELECT answer_id, 'MISSING_CITATION_TEXT', p FROM a2 WHERE kind IN (3, 8) AND there UNION ALL SELECT answer_id, 'UNGROUNDED_CITATION_TEXT', p FROM a2 WHERE kind = 4 AND there) SELECT * FROM v""",
)
def ans_validate(m: Model) -> DataFrame:
    return an.violations(answers(m), m.chunks)


QUOTED = f"""WITH {C}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_slug ORDER BY start_line DESC) AS back, count(*) OVER (PARTITION BY doc_slug) AS n FROM c),
z AS (SELECT doc_id, doc_slug, verbatim_text AS said, trim(regexp_replace(verbatim_text, '\\s+', ' ', 'g')) AS plain FROM o WHERE back = 1),
held AS (SELECT z.doc_id, min(c.path) AS leaf FROM z JOIN c USING (doc_slug) WHERE contains(trim(regexp_replace(c.verbatim_text, '\\s+', ' ', 'g')), plain) GROUP BY ALL),
lone AS (SELECT doc_slug, min(path) AS first FROM c GROUP BY doc_slug)
SELECT h.doc_id AS answer_id, i, CASE i WHEN 2 THEN f.first ELSE h.leaf END AS leaf, i <> 2 AS grounded, CASE WHEN i = 2 AND f.first <> h.leaf THEN 2 ELSE 1 END AS k FROM held h JOIN z USING (doc_id) JOIN lone f USING (doc_slug), unnest([1, 2, 3]) AS u(i)"""


@query("ans_resolve_quotes", QUOTED)
def ans_resolve_quotes(m: Model) -> DataFrame:
    """An answer a document that quotes its last line, with other white space, against the whole document: the leaf that holds it, not the first, and
    citations of one leaf share a number. The second citation quotes what nothing says and gets the first leaf."""
    last = m.chunks.groupBy("doc_id", "doc_slug").agg(F.max_by("verbatim_text", "start_line").alias("said"))
    spaced = F.concat(F.lit(" "), F.replace("said", F.lit(" "), F.lit("  ")), F.lit("\n"))
    cite = lambda quote: F.struct(F.col("doc_slug").alias("path"), quote.alias("citation_text"))
    a = last.select(F.col("doc_id").alias("answer_id"), F.lit("x [#1]").alias("answer"), F.lit(False).alias("abstained"), F.array(cite(F.col("said")), cite(F.lit("never said this\u2020")), cite(spaced)).alias("citations"))
    looked = an.resolved(an.cited(a), m.chunks)
    numbers = an.numbered(looked).select("answer_id", "i", "k")
    return looked.join(numbers, ["answer_id", "i"]).select("answer_id", F.col("i").cast("long").alias("i"), "leaf", "grounded", F.col("k").cast("long").alias("k"))


@query("ans_resolve", f"WITH {C}, {ANSWERS} SELECT answer_id, i, p AS leaf, 1 AS k FROM a2, unnest([1, 2]) AS u(i) WHERE there AND kind NOT IN (0, 7) AND NOT (i = 1 AND kind IN (1, 2))")
def ans_resolve(m: Model) -> DataFrame:
    return an.numbered(an.resolved(an.cited(answers(m)), m.chunks)).select("answer_id", F.col("i").cast("long").alias("i"), "leaf", F.col("k").cast("long").alias("k"))


@query(
    "ans_renumber",
    f"""WITH {C}, {ANSWERS}, r AS (SELECT answer_id, kind, there AND kind NOT IN (0, 7) AS has, trim(CASE WHEN kind = 5 THEN ' ' ELSE text || CASE WHEN kind IN (6, 8) THEN CASE kind WHEN 6 THEN ' ' ELSE '' END
 ELSE ' ' || CASE WHEN there AND kind NOT IN (0, 7) THEN '[#1]' ELSE '' END || ' and ' || CASE WHEN there AND kind NOT IN (0, 1, 2, 7) THEN '[#1]' ELSE '' END END END) AS t FROM a2)
 SELECT answer_id, CASE WHEN has AND NOT contains(t, '[#1]') THEN t || ' [#1]' ELSE t END AS answer FROM r""",
)
def ans_renumber(m: Model) -> DataFrame:
    a = answers(m)
    return an.renumber(a, an.numbered(an.resolved(an.cited(a), m.chunks)))

