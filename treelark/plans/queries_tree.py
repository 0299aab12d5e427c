"""Lookup and navigation queries over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.functions import paths as p
from treelark.operators import lookup as lk
from treelark.operators import navigate as nav
from treelark.plans.model import EDGES, RELATION_ROWS, TREE, C, D, Model
from treelark.plans.registry import query

SLUGS = "s AS (SELECT DISTINCT source || '.doc_' || doc_id AS doc_slug FROM labels JOIN documents USING (doc_id))"


def slugs(m: Model) -> DataFrame:
    """The slugs of all labelled documents, as a batch of keys."""
    return m.docs.join(m.table("labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_slug")


@query("lk_docs", f"WITH {D}, {SLUGS} SELECT doc_id, doc_slug, title FROM d WHERE doc_slug IN (SELECT doc_slug FROM s)")
def lk_docs(m: Model) -> DataFrame:
    return lk.by_keys(m.docs, slugs(m), "doc_slug").select("doc_id", "doc_slug", "title")


@query("lk_docs_prefix", f"WITH {D}, px AS (SELECT DISTINCT source AS prefix FROM documents) SELECT prefix, doc_slug FROM d JOIN px ON contains(doc_slug, prefix)")
def lk_docs_prefix(m: Model) -> DataFrame:
    prefixes = m.docs.select(F.col("source").alias("prefix")).distinct()
    return lk.docs_by_prefix(prefixes, m.docs).select("prefix", "doc_slug")


@query("lk_chunks", f"WITH {C}, k AS (SELECT path FROM c WHERE start_line = 1) SELECT path, md5(verbatim_text) AS id FROM c WHERE path IN (SELECT path FROM k)")
def lk_chunks(m: Model) -> DataFrame:
    keys = m.docs.select(F.concat("doc_slug", F.lit(".s_1")).alias("path"))
    return lk.resolve(keys, m.chunks.withColumn("id", F.md5("verbatim_text")), "path", "id")


@query("lk_doc_stats", f"WITH {C} SELECT d.doc_slug, title, count(c.path) AS chunk_count FROM d LEFT JOIN c ON c.doc_slug = d.doc_slug GROUP BY ALL")
def lk_doc_stats(m: Model) -> DataFrame:
    return lk.doc_stats(m.docs, m.chunks)


@query("lk_manifest", f"WITH {D} SELECT doc_slug, '| ' || doc_slug || ' | ' || regexp_replace(title, '[\\n|]', ' ', 'g') || ' |' AS line FROM d")
def lk_manifest(m: Model) -> DataFrame:
    return lk.manifest(m.docs)


@query("lk_relations", f"WITH r(code, description, is_symmetric) AS (VALUES {RELATION_ROWS}), {EDGES} SELECT code, description, is_symmetric, count(source) AS n_edges FROM r LEFT JOIN edges ON relation_type = code GROUP BY ALL")
def lk_relations(m: Model) -> DataFrame:
    """The catalogue of relations with the number of edges that use each."""
    n = m.edges.groupBy(F.col("relation_type").alias("code")).agg(F.count("*").alias("n_edges"))
    return m.relations.join(n, "code", "left").select("code", "description", "is_symmetric", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query(
    "lk_raw_slice",
    f"""WITH {C}, rq AS (SELECT doc_id AS request_id, CASE doc_id % 4 WHEN 0 THEN doc_slug WHEN 1 THEN doc_slug || '.s_1' WHEN 2 THEN doc_slug || '.none.x' ELSE 'no.such' END AS key,
 CASE WHEN doc_id % 5 = 4 THEN 500 ELSE 1 + doc_id % 3 END AS start_line, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 0 ELSE 3 + doc_id % 3 END AS end_line FROM d),
 r AS (SELECT rq.*, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.path = key) THEN d.doc_slug ELSE d.doc_slug END AS slug, string_split(raw_text, chr(10)) AS lines FROM rq JOIN d ON d.doc_id = request_id),
 e AS (SELECT *, CASE WHEN slug IS NULL THEN 'NOT_FOUND' WHEN end_line < start_line THEN 'INVERTED_RANGE' WHEN start_line > len(lines) THEN 'OUT_OF_RANGE' END AS error, least(coalesce(end_line, len(lines)), start_line + 199, len(lines)) AS stop FROM r)
 SELECT request_id, slug AS doc_slug, CASE WHEN error IS NULL THEN start_line END AS first_line, CASE WHEN error IS NULL THEN stop END AS last_line, CASE WHEN error IS NULL THEN array_to_string(lines[start_line:stop], chr(10)) END AS text, error FROM e""",
)
def lk_raw_slice(m: Model) -> DataFrame:
    d, k = m.docs, F.col("doc_id")
    key = F.when(k % 4 == 0, F.col("doc_slug")).when(k % 4 == 1, F.concat("doc_slug", F.lit(".s_1"))).when(k % 4 == 2, F.concat("doc_slug", F.lit(".none.x"))).otherwise("no.such")
    end = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.lit(0)).otherwise(3 + k % 3)
    requests = d.select(k.alias("request_id"), key.alias("key"), F.when(k % 5 == 4, 500).otherwise(1 + k % 3).cast("long").alias("start_line"), end.cast("long").alias("end_line"))
    return lk.raw_slices(requests, d, m.chunks)


ANCHORS = "an AS (SELECT p AS anchor FROM cp UNION ALL SELECT p FROM np)"


def anchors(m: Model) -> DataFrame:
    """All customers and nations."""
    return m.tree.where(p.nlevel(F.col("path")).between(2, 3)).select(F.col("path").alias("anchor"))


def shape(df: DataFrame) -> DataFrame:
    return df.select("anchor", "path", "start_line", "relative_depth")


@query("nav_ltree", f"WITH {TREE} SELECT path, level AS nlevel, parent, array_to_string(string_split(path, '.')[2:3], '.') AS mid, path = 'r1' OR starts_with(path, 'r1.') AS under_r1 FROM tree")
def nav_ltree(m: Model) -> DataFrame:
    c = F.col("path")
    return m.tree.select("path", p.nlevel(c).alias("nlevel"), F.coalesce(p.parent_path(c), F.lit("")).alias("parent"), F.array_join(F.slice(p.labels(c), 2, 2), ".").alias("mid"), p.is_under(c, F.lit("r1")).alias("under_r1"))


@query("nav_children", f"WITH {TREE}, {ANCHORS} SELECT anchor, path, start_line, 1 AS relative_depth FROM tree JOIN an ON parent = anchor")
def nav_children(m: Model) -> DataFrame:
    return shape(nav.children(anchors(m), m.tree))


@query("nav_parent_chain", f"WITH {TREE}, {ANCHORS} SELECT anchor, path, start_line, level - len(string_split(anchor, '.')) AS relative_depth FROM an JOIN tree ON level < len(string_split(anchor, '.')) AND starts_with(anchor, path || '.')")
def nav_parent_chain(m: Model) -> DataFrame:
    return shape(nav.parent_chain(anchors(m), m.tree))


@query("nav_siblings", f"WITH {TREE}, an AS (SELECT path AS anchor, parent AS ap, level AS lv FROM tree WHERE start_line % 100 = 0 OR level = 2) SELECT anchor, path, start_line, 0 AS relative_depth FROM an JOIN tree ON parent = ap AND path <> anchor AND level = lv AND level > 1")
def nav_siblings(m: Model) -> DataFrame:
    """Siblings of all nations, and of every hundredth customer and order."""
    some = m.tree.where((F.col("start_line") % 100 == 0) | (p.nlevel(F.col("path")) == 2)).where(p.nlevel(F.col("path")) > 1).select(F.col("path").alias("anchor"))
    return shape(nav.siblings(some, m.tree))


@query("nav_subtree", f"WITH {TREE}, {ANCHORS} SELECT anchor, path, start_line, level - len(string_split(anchor, '.')) AS relative_depth FROM tree, unnest(range(1, level)) AS u(k) JOIN an ON anchor = array_to_string(string_split(path, '.')[1:k], '.')")
def nav_subtree(m: Model) -> DataFrame:
    return shape(nav.subtree(anchors(m), m.tree_by_path))


@query("nav_subtree_runs", f"WITH {TREE}, an AS (SELECT path AS anchor FROM tree WHERE level <= 2) SELECT anchor, path, start_line, level - len(string_split(anchor, '.')) AS relative_depth FROM tree JOIN an ON starts_with(path, anchor || '.')")
def nav_subtree_runs(m: Model) -> DataFrame:
    """The subtrees of all regions and nations: few anchors, one inside the other, whose runs are pushed to the scan."""
    top = m.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("anchor"))
    below = m.table("nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".n"), F.col("n_nationkey").cast("string")).alias("anchor"))
    return shape(nav.subtree(top.unionByName(below), m.tree_by_path))


@query(
    "nav_virtual_parents",
    f"""WITH {C}, a AS (SELECT path AS anchor, [source, 'doc_' || doc_id] AS t, end_line FROM c), r AS (SELECT *, unnest(range(1, len(string_split(anchor, '.')))) AS k, len(string_split(anchor, '.')) AS lv FROM a)
 SELECT anchor, sha1(anchor || ':' || array_to_string(string_split(anchor, '.')[1:k], '.')) AS id, array_to_string(string_split(anchor, '.')[1:k], '.') AS path, t[least(k, len(t))] AS verbatim_text, '[' || array_to_string(t[1:least(k, len(t))], ' > ') || ']' || chr(10) || t[least(k, len(t))] AS contextualized_text,
 1 AS start_line, end_line, CASE WHEN k = 1 THEN 'DOCUMENT' ELSE 'SECTION' END AS node_type, k - lv AS relative_depth FROM r""",
)
def nav_virtual_parents(m: Model) -> DataFrame:
    titles = F.array(F.col("source"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return nav.virtual_parents(m.chunks.select(F.col("path").alias("anchor"), titles.alias("ancestor_titles"), F.lit(1).alias("doc_level"), "end_line"))


@query(
    "nav_resolve_anchor",
    f"""WITH {C}, rq AS (SELECT doc_id AS request_id, CASE doc_id % 4 WHEN 0 THEN doc_slug || '.s_1' WHEN 1 THEN 'x.' || doc_slug || '.s_1' WHEN 2 THEN 'y.doc_' || doc_id || 'q' ELSE doc_slug END AS raw FROM d),
 f AS (SELECT doc_id, arg_min(path, start_line) AS path FROM c GROUP BY doc_id), s1 AS (SELECT doc_id, path FROM c WHERE start_line = 1)
 SELECT request_id, raw, CASE WHEN request_id % 4 = 2 THEN NULL WHEN request_id % 4 = 3 THEN f.path ELSE coalesce(s1.path, f.path) END AS anchor, CASE WHEN request_id % 4 = 2 OR f.path IS NULL THEN 'ANCHOR_NOT_FOUND' END AS error
 FROM rq LEFT JOIN f ON f.doc_id = request_id LEFT JOIN s1 ON s1.doc_id = request_id""",
)
def nav_resolve_anchor(m: Model) -> DataFrame:
    k, slug = F.col("doc_id"), F.col("doc_slug")
    raw = F.when(k % 4 == 0, F.concat(slug, F.lit(".s_1"))).when(k % 4 == 1, F.concat(F.lit("x."), slug, F.lit(".s_1"))).when(k % 4 == 2, F.concat(F.lit("y.doc_"), k.cast("string"), F.lit("q"))).otherwise(slug)
    return nav.resolve_anchors(m.docs.select(k.alias("request_id"), raw.alias("raw")), m.docs, m.chunks)


@query("nav_children_fallback", f"WITH {C}, an AS (SELECT source AS anchor FROM documents UNION SELECT source || '.doc_' || doc_id FROM documents) SELECT anchor, path, start_line, 1 AS relative_depth FROM c, unnest([source, doc_slug]) AS u(anchor)")
def nav_children_fallback(m: Model) -> DataFrame:
    a = m.docs.select(F.explode(F.array("source", "doc_slug")).alias("anchor")).distinct()
    return shape(nav.children_or_all(a, m.chunks))


@query("nav_limit", f"WITH {TREE}, {ANCHORS} SELECT anchor, path, nth, total, total > 7 AS truncated FROM (SELECT anchor, path, row_number() OVER (PARTITION BY anchor ORDER BY start_line, path) AS nth, count(*) OVER (PARTITION BY anchor) AS total FROM tree JOIN an ON parent = anchor) WHERE nth <= 7")
def nav_limit(m: Model) -> DataFrame:
    return nav.page(nav.children(anchors(m), m.tree), 7, "start_line", "path").select("anchor", "path", "nth", "total", "truncated")


@query("nav_expand_leaves", f"WITH {C}, k AS (SELECT DISTINCT unnest([doc_slug, doc_slug || '.s_1', doc_slug || '.zz']) AS query_path, doc_slug FROM d), e AS (SELECT query_path, coalesce(CASE WHEN bool_or(path = query_path) THEN query_path ELSE string_agg(path, ',' ORDER BY path) FILTER (WHERE starts_with(path, query_path || '.')) END, '') AS leaves FROM k LEFT JOIN c USING (doc_slug) GROUP BY query_path) SELECT * FROM e")
def nav_expand_leaves(m: Model) -> DataFrame:
    s = F.col("doc_slug")
    keys = m.docs.select(F.explode(F.array(s, F.concat(s, F.lit(".s_1")), F.concat(s, F.lit(".zz")))).alias("query_path"))
    return nav.expand_leaves(keys, m.paths).withColumn("leaves", F.array_join("leaves", ","))


LEAVES = "lv AS (SELECT path, title, start_line, end_line, doc_slug FROM tree WHERE level = 4)"
NODES = f"""WITH {TREE}, {LEAVES}, up AS (SELECT doc_slug, array_to_string(string_split(path, '.')[1:k], '.') AS node, path, title, start_line, end_line FROM lv, unnest(range(1, 5)) AS u(k)),
 n AS (SELECT doc_slug, node AS path, max(title) FILTER (WHERE path = node) AS own, min(start_line) AS start_line, max(end_line) AS end_line, count(*) FILTER (WHERE path <> node) AS below, bool_or(path = node) AS is_chunk FROM up GROUP BY ALL)"""


@query("nav_tree_nodes", NODES + " SELECT doc_slug, path, nullif(array_to_string(string_split(path, '.')[1:-2], '.'), '') AS parent_path, coalesce(own, string_split(path, '.')[-1]) AS label, CASE WHEN NOT contains(path, '.') THEN 'DOCUMENT' WHEN is_chunk THEN CASE WHEN start_line % 5 = 0 THEN 'TABLE' WHEN start_line % 5 = 1 THEN 'ARTICLE' ELSE 'PARAGRAPH' END ELSE 'SECTION' END AS node_type FROM n")
def nav_tree_nodes(m: Model) -> DataFrame:
    k = F.col("start_line") % 5
    orders = m.tree.where(p.nlevel(F.col("path")) == 4).withColumns({"is_table": k == 0, "node_type": F.when(k == 1, "ARTICLE")})
    return nav.tree_nodes(orders).select("doc_slug", "path", "parent_path", "label", "node_type")


@query("nav_span_rollup", NODES + " SELECT path, start_line, end_line, below FROM n")
def nav_span_rollup(m: Model) -> DataFrame:
    return nav.tree_nodes(m.tree.where(p.nlevel(F.col("path")) == 4)).select("path", "start_line", "end_line", "below")


@query("nav_humanise", """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'Chương ' || upper(split_part(o_orderpriority, '-', 1)) WHEN 1 THEN 'Điều ' || o_orderkey || 'a' WHEN 2 THEN 'Tiểu mục ' || o_orderkey || ' B'
 WHEN 3 THEN 'Phần ' || o_orderkey WHEN 4 THEN 'Khoản ' || o_orderkey || ' c' WHEN 5 THEN 'Phụ lục ' || o_orderkey || 'D' WHEN 6 THEN 'Mục ' || o_orderkey ELSE 'x_y_' || o_orderkey END AS label FROM orders""")
def nav_humanise(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    forms = [("chuong_", F.lower(F.substring_index("o_orderpriority", "-", 1))), ("dieu_", F.concat(k.cast("string"), F.lit("a"))), ("Tieu_muc_", F.concat(k.cast("string"), F.lit("_b"))), ("phan_", k.cast("string")),
             ("khoan_", F.concat(k.cast("string"), F.lit("_c"))), ("phu_luc_", F.concat(k.cast("string"), F.lit("d"))), ("muc_", k.cast("string"))]
    seg = F.concat(F.lit("x_y_"), k.cast("string"))
    for n, (prefix, rest) in enumerate(forms):
        seg = F.when(k % 9 == n, F.concat(F.lit(prefix), rest)).otherwise(seg)
    return m.table("orders").select("o_orderkey", p.humanise(seg).alias("label"))


@query("nav_natural_sort", f"WITH {C} SELECT doc_slug, path, row_number() OVER (PARTITION BY doc_slug ORDER BY start_line) AS nth FROM c")
def nav_natural_sort(m: Model) -> DataFrame:
    from pyspark.sql import Window

    keyed = m.chunks.withColumn("k", p.natural_key(F.col("path")))
    return keyed.select("doc_slug", "path", F.row_number().over(Window.partitionBy("doc_slug").orderBy("k")).cast("long").alias("nth"))


@query("nav_edge_counts", f"WITH {EDGES} SELECT path, count(*) AS n FROM (SELECT source AS path FROM edges UNION ALL SELECT target FROM edges) GROUP BY path")
def nav_edge_counts(m: Model) -> DataFrame:
    return nav.edge_counts(m.edges)
