"""Search queries over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.functions import text as tx
from treelark.operators import search as se
from treelark.plans.model import COSINE, EMBEDDED, C, D, Model, Q
from treelark.plans.registry import query

W = "'[^\\p{L}\\p{N}_]+'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), {W}), lambda t: t <> '')"



DENSE = f"""dn AS (SELECT query_id, path, {COSINE.format(a="q.query_vector", b="emb.embedding")} AS dense_similarity FROM q JOIN emb ON q.query_vector IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_similarity DESC, path) AS dense_rank FROM dn) WHERE dense_rank <= 120)"""


def sparse(text: str) -> str:
    return f"""qt AS (SELECT query_id, {words("query_text")} AS qt FROM q),
ct AS (SELECT path, {words(text)} AS ct FROM c),
qw AS (SELECT query_id, unnest(list_distinct(qt)) AS token, len(list_distinct(qt)) AS n FROM qt),
qp AS (SELECT DISTINCT query_id, qt[i] AS token, qt[i + 1] AS next FROM qt, unnest(range(1, len(qt))) AS u(i)),
cw AS (SELECT path, unnest(ct) AS token FROM ct),
tf AS (SELECT path, token, count(*) AS tf FROM cw GROUP BY ALL),
cp2 AS (SELECT DISTINCT path, ct[i] AS token, ct[i + 1] AS next FROM ct, unnest(range(1, len(ct))) AS u(i)),
ph AS (SELECT DISTINCT query_id, path FROM qp JOIN cp2 USING (token, next)),
sc AS (SELECT query_id, path, sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.644934) AS s, count(*) AS hit, max(n) AS n FROM qw JOIN tf USING (token) GROUP BY ALL),
pool AS (SELECT query_id, path, round((s / n) / (s / n + 1), 6) AS base, hit = n AS all_match FROM sc LEFT JOIN (SELECT *, true AS phrase FROM ph) USING (query_id, path) WHERE phrase OR hit = n),
sparse AS (SELECT * FROM (SELECT query_id, path, sparse_score, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, path) AS sparse_rank FROM
 (SELECT query_id, path, round(base * 4 + CASE WHEN all_match THEN 2.0 ELSE 0.0 END, 6) AS sparse_score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, path) AS p FROM pool) WHERE p <= 240)) WHERE sparse_rank <= 120)"""


RRF = """rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, path) AS rank FROM (SELECT query_id, path,
 round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 6) AS rrf_score, coalesce(dense_rank, 999) AS dense_rank, coalesce(sparse_rank, 999) AS sparse_rank,
 coalesce(dense_similarity, 0.0) AS dense_similarity FROM dense FULL OUTER JOIN sparse USING (query_id, path)))"""
BASE = f"WITH {C}, {EMBEDDED}, {Q}, {DENSE}, {sparse('contextualized_text')}, {RRF}"
GREP = f"WITH {C}, {Q}, hits AS (SELECT query_id, query_text, c.* FROM q JOIN c ON query_text <> '' AND (contains(verbatim_text, query_text) OR contains(contextualized_text, query_text)))"


def tri(text: str) -> str:
    return f"list_distinct(flatten(list_transform({words(text)}, lambda w: list_transform(range(1, len(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"



JACC = "coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def patterns(m: Model) -> DataFrame:
    return m.search_queries.select("query_id", F.col("query_text").alias("pattern"), "query_text")


def hybrid(m: Model, limit: int = 10) -> DataFrame:
    return se.hybrid(m.search_queries, m.chunks, m.embedded, limit)


def grep(m: Model, **flags) -> DataFrame:
    return se.grep(patterns(m), m.chunks, **flags)


def venn(m: Model, limit: int = 10) -> DataFrame:
    return se.venn(hybrid(m, limit), se.grep_page(grep(m), limit))


@query("se_rrf", f"{BASE} SELECT query_id, path, rrf_score, dense_rank, sparse_rank, dense_similarity, rank FROM rrf WHERE rank <= 10")
def se_rrf(m: Model) -> DataFrame:
    return hybrid(m)


@query("se_dense", f"WITH {C}, {EMBEDDED}, {Q}, {DENSE} SELECT query_id, path, dense_similarity, dense_rank FROM dense")
def se_dense(m: Model) -> DataFrame:
    return se.dense_top(m.search_queries, m.embedded, 120)


@query("se_sparse_pool", f"WITH {C}, {Q}, {sparse('contextualized_text')} SELECT query_id, path, base, all_match FROM pool")
def se_sparse_pool(m: Model) -> DataFrame:
    return se.sparse_pool(m.search_queries, m.chunks)


@query("se_sparse_rank", f"WITH {C}, {Q}, {sparse('contextualized_text')} SELECT query_id, path, sparse_score, sparse_rank FROM sparse")
def se_sparse_rank(m: Model) -> DataFrame:
    return se.sparse_top(m.search_queries, m.chunks)


@query("se_sparse_verbatim", f"WITH {C}, {Q}, {sparse('verbatim_text')} SELECT query_id, path, sparse_score, sparse_rank FROM sparse")
def se_sparse_verbatim(m: Model) -> DataFrame:
    return se.sparse_top(m.search_queries, m.chunks, text="verbatim_text")


@query("se_degrade", f"WITH {C}, {Q}, {sparse('contextualized_text')}, dense AS (SELECT query_id, path, 0::BIGINT AS dense_rank, 0.0::DOUBLE AS dense_similarity FROM sparse WHERE false), {RRF} SELECT query_id, path, rrf_score, dense_rank, sparse_rank, dense_similarity, rank FROM rrf WHERE rank <= 10")
def se_degrade(m: Model) -> DataFrame:
    none = m.search_queries.withColumn("query_vector", F.lit(None).cast("array<float>"))
    return se.hybrid(none, m.chunks, m.embedded)


@query("se_tokenise", f"WITH {Q} SELECT query_id, array_to_string(t, ' & ') AS and_query, CASE WHEN len(t) < 2 THEN array_to_string(t, '') ELSE array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' <-> ' || t[i + 1]), ' | ') END AS any_query FROM (SELECT query_id, {words('query_text')} AS t FROM q)")
def se_tokenise(m: Model) -> DataFrame:
    t = m.search_queries.select("query_id", tx.tokens(F.col("query_text")).alias("t"))
    pairs = F.when(F.size("t") < 2, F.array_join("t", "")).otherwise(F.array_join(F.transform(F.expr("slice(t, 1, greatest(size(t) - 1, 0))"), lambda x, i: F.concat(x, F.lit(" <-> "), F.get(F.col("t"), i + 1))), " | "))
    return t.select("query_id", F.array_join("t", " & ").alias("and_query"), pairs.alias("any_query"))


@query("se_scope", f"WITH {C}, {Q} SELECT query_id, count(*) AS n, min(path) AS first_path FROM q JOIN (SELECT doc_id, source FROM documents) d0 ON d0.doc_id = query_id JOIN c ON c.doc_slug = d0.source || '.doc_' || d0.doc_id GROUP BY query_id")
def se_scope(m: Model) -> DataFrame:
    mine = m.docs.select(F.col("doc_id").alias("query_id"), F.array("doc_slug").alias("doc_slugs"), F.col("doc_slug").alias("path_prefix"))
    q = m.search_queries.select("query_id").join(mine, "query_id")
    return se.scoped(q, m.paths).groupBy("query_id").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("se_scope_prefix", f"WITH {C}, {Q}, r AS (SELECT source, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM c GROUP BY source) SELECT query_id, n, first_path, last_path FROM q JOIN documents d0 ON d0.doc_id = query_id JOIN r ON r.source = d0.source")
def se_scope_prefix(m: Model) -> DataFrame:
    """Queries that are scoped by a path alone: the source of the document of their id."""
    mine = m.docs.select(F.col("doc_id").alias("query_id"), F.lit(None).cast("array<string>").alias("doc_slugs"), F.col("source").alias("path_prefix"))
    q = m.search_queries.select("query_id").join(mine, "query_id")
    return se.scoped(q, m.paths).groupBy("query_id").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@query("se_grep_literal", f"{GREP} SELECT query_id, path, start_line FROM hits")
def se_grep_literal(m: Model) -> DataFrame:
    return grep(m).select("query_id", "path", "start_line")


@query("se_grep_insensitive", f"WITH {C}, {Q} SELECT query_id, path FROM q JOIN c ON query_text <> '' AND contains(lower(contextualized_text), lower(query_text))")
def se_grep_insensitive(m: Model) -> DataFrame:
    return grep(m, case_sensitive=False).select("query_id", "path")


@query("se_grep_regex", f"WITH {C}, {Q}, p AS (SELECT query_id, regexp_extract(query_text, '^[A-Za-z]+') || '[a-z]*[ ,]' AS pattern FROM q WHERE regexp_matches(query_text, '^[A-Za-z]')) SELECT query_id, path FROM p JOIN c ON regexp_matches(verbatim_text, pattern) OR regexp_matches(contextualized_text, pattern)")
def se_grep_regex(m: Model) -> DataFrame:
    p = m.search_queries.where(F.col("query_text").rlike("^[A-Za-z]"))
    p = p.select("query_id", F.concat(F.regexp_extract("query_text", "^[A-Za-z]+", 0), F.lit("[a-z]*[ ,]")).alias("pattern"))
    return se.grep(p, m.chunks, regex=True).select("query_id", "path")


@query("se_grep_count", f"{GREP} SELECT q.query_id, count(h.path) AS n FROM q LEFT JOIN hits h ON q.query_id = h.query_id GROUP BY q.query_id")
def se_grep_count(m: Model) -> DataFrame:
    n = grep(m).groupBy("query_id").agg(F.count("*").alias("n"))
    return m.search_queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("se_grep_order", f"{GREP} SELECT query_id, path, total_count, rank FROM (SELECT query_id, path, count(*) OVER (PARTITION BY query_id) AS total_count, row_number() OVER (PARTITION BY query_id ORDER BY doc_slug, start_line, path) AS rank FROM hits) WHERE rank <= 10")
def se_grep_order(m: Model) -> DataFrame:
    return se.grep_page(grep(m), 10).select("query_id", "path", "total_count", "rank")


_VT = tri("array_to_string(ws[k:k + n - 1], ' ')")


@query("se_trigram", f"""{GREP}, w AS (SELECT query_id, path, query_text, {words('verbatim_text')} AS ws, greatest(len({words('query_text')}), 1) AS n FROM hits),
 s AS (SELECT query_id, path, {JACC.format(a=tri('query_text'), b=_VT)} AS s FROM w, unnest(range(1, greatest(len(ws) - n + 1, 1) + 1)) AS u(k) WHERE len(ws) > 0)
 SELECT query_id, path, round(max(s), 6) AS word_similarity FROM s GROUP BY ALL""")
def se_trigram(m: Model) -> DataFrame:
    return grep(m).select("query_id", "path", F.round(tx.word_similarity(F.col("pattern"), F.col("verbatim_text")), 6).alias("word_similarity"))


@query("se_trigram_match", f"WITH {C}, {Q}, w AS (SELECT query_id, {tri('query_text')} AS a FROM q), t AS (SELECT path, {tri('verbatim_text')} AS b FROM c), wa AS (SELECT query_id, len(a) AS na, unnest(a) AS g FROM w), tb AS (SELECT path, len(b) AS nb, unnest(b) AS g FROM t WHERE len(b) * 0.3 <= (SELECT max(len(a)) FROM w)), k AS (SELECT query_id, path, na, nb, count(*) AS k FROM wa JOIN tb USING (g) GROUP BY ALL), s AS (SELECT query_id, path, round(k::DOUBLE / (na + nb - k), 6) AS similarity FROM k) SELECT * FROM s WHERE similarity >= 0.3")
def se_trigram_match(m: Model) -> DataFrame:
    """Lines similar to a pattern as whole texts, by their trigrams."""
    q = m.search_queries.select("query_id", F.col("query_text").alias("pattern"))
    return se.similar_texts(q, m.chunks.select("path", "verbatim_text"), "verbatim_text", 0.3).select("query_id", "path", "similarity")


@query("se_grep_similar", f"WITH {C}, {Q}, w AS (SELECT query_id, query_text, {tri('query_text')} AS a FROM q), t AS (SELECT path, contextualized_text AS ct, {tri('verbatim_text')} AS b FROM c), j AS (SELECT query_id, path, contains(lower(ct), lower(query_text)) AS held, len(list_intersect(a, b)) AS k, len(a) AS na, len(b) AS nb FROM w JOIN t ON true) SELECT query_id, path FROM j WHERE held OR round(k::DOUBLE / (na + nb - k), 6) >= 0.45")
def se_grep_similar(m: Model) -> DataFrame:
    """A search that ignores case, with texts of a like make beside those that hold the pattern."""
    return grep(m, case_sensitive=False, similar=0.45).select("query_id", "path")


PIECES = "regexp_extract_all(query_text, '[A-Za-z]{3,}')"


@query("se_grep_alternatives", f"WITH {C}, {Q}, p AS (SELECT query_id, '(' || w[2] || '|' || w[3] || 'x?) [a-z]+.*' || w[4] AS pattern FROM (SELECT query_id, {PIECES} AS w FROM q) WHERE len(w) >= 4) SELECT query_id, path FROM p JOIN c ON regexp_matches(verbatim_text, pattern) OR regexp_matches(contextualized_text, pattern)")
def se_grep_alternatives(m: Model) -> DataFrame:
    """Expressions with alternatives, optional parts and gaps."""
    w = m.search_queries.select("query_id", F.regexp_extract_all("query_text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w")).where("size(w) >= 4")
    pattern = F.concat(F.lit("("), F.get("w", F.lit(1)), F.lit("|"), F.get("w", F.lit(2)), F.lit("x?) [a-z]+.*"), F.get("w", F.lit(3)))
    return se.grep(w.select("query_id", pattern.alias("pattern")), m.chunks, regex=True).select("query_id", "path")


@query("se_grep_wildcards", f"WITH {C}, {Q}, p AS (SELECT query_id, w[2] || '%' || w[3] || '_' || w[4] AS pattern FROM (SELECT query_id, {PIECES} AS w FROM q) WHERE len(w) >= 4) SELECT query_id, path FROM p JOIN c ON verbatim_text LIKE '%' || pattern || '%' OR contextualized_text LIKE '%' || pattern || '%'")
def se_grep_wildcards(m: Model) -> DataFrame:
    """LIKE patterns, looked up in the same index."""
    w = m.search_queries.select("query_id", F.regexp_extract_all("query_text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w")).where("size(w) >= 4")
    pattern = F.concat(F.get("w", F.lit(1)), F.lit("%"), F.get("w", F.lit(2)), F.lit("_"), F.get("w", F.lit(3)))
    return se.grep(w.select("query_id", pattern.alias("pattern")), m.chunks, literal=False).select("query_id", "path")


OVERLAP = f"round(coalesce(len(list_intersect(list_distinct({words('query_text')}), {words('verbatim_text')}))::DOUBLE / nullif(len(list_distinct({words('query_text')})), 0), 0), 6)"
RERANKED = f"""{BASE}, pooled AS (SELECT rrf.*, query_text, verbatim_text FROM rrf JOIN q USING (query_id) JOIN c USING (path) WHERE rank <= 20),
ce AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS ce_rank FROM (SELECT *, {OVERLAP} AS rerank_score FROM pooled)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {{order}}) AS new_rank FROM ce)"""
PLAIN_ORDER = RERANKED.replace("{order}", "ce_rank")


def reranked(m: Model, pool: int = 20, **how) -> DataFrame:
    hits = se.with_texts(hybrid(m, pool), m.chunks.select("path", "verbatim_text")).join(m.search_queries.select("query_id", "query_text"), "query_id")
    return se.rerank(hits, **how)


@query("se_rerank", RERANKED.replace("{order}", "round(0.7::DOUBLE / (ce_rank + 60) + (1 - 0.7::DOUBLE) / (rank + 60), 9) DESC, rank") + " SELECT query_id, path, rank, rerank_score, new_rank FROM rr WHERE new_rank <= 10")
def se_rerank(m: Model) -> DataFrame:
    return reranked(m, blend=0.7).select("query_id", "path", "rank", "rerank_score", "new_rank")


LEVEL = "CASE WHEN sim IS NULL THEN 'none' WHEN ce < -1.0 THEN CASE WHEN sim >= 0.7 OR sp THEN 'low' ELSE 'none' END WHEN sim >= 0.82 AND sp THEN 'high' WHEN sim >= 0.7 AND sp THEN 'medium' WHEN sim >= 0.7 OR sp THEN 'low' ELSE 'none' END"


@query("se_confidence", f"{BASE}, by_query AS (SELECT query_id, max(dense_similarity) AS sim, bool_or(sparse_rank < 999) AS sp, NULL::DOUBLE AS ce FROM rrf WHERE rank <= 10 GROUP BY query_id) SELECT query_id, {LEVEL} AS confidence FROM q LEFT JOIN by_query USING (query_id)")
def se_confidence(m: Model) -> DataFrame:
    return se.confidence(m.search_queries, hybrid(m))


@query("se_search", PLAIN_ORDER + f", cut AS (SELECT * FROM rr WHERE new_rank <= 10), by_query AS (SELECT query_id, max(dense_similarity) AS sim, bool_or(sparse_rank < 999) AS sp, max(rerank_score) AS ce FROM cut GROUP BY query_id) SELECT query_id, path, new_rank, rerank_score, rrf_score, {LEVEL} AS confidence FROM cut JOIN by_query USING (query_id)")
def se_search(m: Model) -> DataFrame:
    hits = reranked(m)
    return hits.join(se.confidence(m.search_queries, hits), "query_id").select("query_id", "path", "new_rank", "rerank_score", "rrf_score", "confidence")


VERBATIM = """hits AS (SELECT query_id, c.* FROM q JOIN c ON query_text <> '' AND (contains(verbatim_text, query_text) OR contains(contextualized_text, query_text))),
vb AS (SELECT * FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY doc_slug, start_line, path) AS v FROM hits) WHERE v <= 10)"""


def venn_sql(semantic: str) -> str:
    """Of the semantic rows (query_id, path, s) and those of vb."""
    return f"""sm AS ({semantic}),
vn AS (SELECT query_id, path, CASE WHEN s IS NULL THEN 2 WHEN v IS NULL THEN 1 ELSE 0 END AS b, coalesce(s, v) AS o FROM sm FULL OUTER JOIN vb USING (query_id, path)),
venn AS (SELECT query_id, path, ['both', 'semantic_only', 'verbatim_only'][b + 1] AS found_in, row_number() OVER (PARTITION BY query_id ORDER BY b, o, path) AS rank FROM vn)"""


VENN = f"{BASE}, {VERBATIM}, {venn_sql('SELECT query_id, path, rank AS s FROM rrf WHERE rank <= 10')}"


@query("se_venn", f"{VENN} SELECT * FROM venn")
def se_venn(m: Model) -> DataFrame:
    return venn(m)


def shown(m: Model) -> DataFrame:
    return se.with_texts(venn(m), m.chunks.select("path", "doc_slug", "start_line", "verbatim_text", F.col("source").alias("context")))


@query("se_group_ranked", f"{VENN} SELECT query_id, doc_slug, context, best_rank, array_to_string(paths, ',') AS paths, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_slug, context) AS group_rank FROM (SELECT query_id, doc_slug, source AS context, min(rank) AS best_rank, list(path ORDER BY start_line, path) AS paths FROM venn JOIN c USING (path) GROUP BY ALL)")
def se_group_ranked(m: Model) -> DataFrame:
    return se.group_ranked(shown(m)).withColumn("paths", F.array_join("paths", ","))


@query("se_group_reading", f"{VENN}, s AS (SELECT query_id, path, rank, doc_slug, CASE WHEN lag(doc_slug) OVER w = doc_slug THEN 0 ELSE 1 END AS ch FROM venn JOIN c USING (path) WINDOW w AS (PARTITION BY query_id ORDER BY doc_slug, start_line, path)) SELECT query_id, path, CAST(sum(ch) OVER (PARTITION BY query_id ORDER BY doc_slug, start_line, path) AS BIGINT) AS group_no FROM s JOIN (SELECT path, start_line FROM c) USING (path)")
def se_group_reading(m: Model) -> DataFrame:
    return se.group_reading(shown(m), ["query_id"], ["doc_slug", "start_line", "path"]).select("query_id", "path", "group_no")


@query("se_doc_catalog", f"{VENN} SELECT DISTINCT query_id, c.doc_slug, coalesce(nullif(title, ''), c.doc_slug) AS title FROM venn JOIN c USING (path) LEFT JOIN d ON d.doc_slug = c.doc_slug")
def se_doc_catalog(m: Model) -> DataFrame:
    return se.doc_catalog(shown(m), m.docs)


@query("se_clean_meta", f"WITH {D} SELECT doc_slug, 'lang=' || lang || ';source=' || source AS metadata FROM d")
def se_clean_meta(m: Model) -> DataFrame:
    meta = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("ancestor_titles"), "title")
    kept = se.clean_metadata(meta)
    return m.docs.select("doc_slug", F.array_join(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), kept[k])), ";").alias("metadata"))


@query("se_grep_view", f"{GREP} SELECT query_id, rank, path, substr(verbatim_text, 1, 150) AS snippet, 'LINE ' || start_line || '-' || end_line AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_slug, start_line, path) AS rank FROM hits) WHERE rank <= 30")
def se_grep_view(m: Model) -> DataFrame:
    return se.grep_view(grep(m))


@query("se_quick_find", f"WITH {C} SELECT doc_slug, path, nth FROM (SELECT doc_slug, path, row_number() OVER (PARTITION BY doc_slug ORDER BY start_line) AS nth FROM c WHERE contains(lower(verbatim_text), 'tion') OR contains(lower(path), 'tion')) WHERE nth <= 12")
def se_quick_find(m: Model) -> DataFrame:
    hit = F.contains(F.lower("verbatim_text"), F.lit("tion")) | F.contains(F.lower("path"), F.lit("tion"))
    return se.top(m.chunks.where(hit), "nth", 12, F.col("start_line"), by="doc_slug").select("doc_slug", "path", "nth")


@query("se_context_pack", f"{BASE} SELECT query_id, count(*) AS sources, string_agg('[' || rank || '] ' || path || chr(10) || verbatim_text, chr(10) || chr(10) ORDER BY rank) AS context FROM rrf JOIN c USING (path) WHERE rank <= 5 GROUP BY query_id")
def se_context_pack(m: Model) -> DataFrame:
    return se.context_pack(hybrid(m), m.chunks)
