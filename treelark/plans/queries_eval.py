"""Retrieval evaluation queries over the model tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.operators import evaluate as ev
from treelark.operators import search as se
from treelark.plans.model import RUNS, C, Model
from treelark.plans.queries_search import PLAIN_ORDER, VENN, VERBATIM, grep, hybrid, reranked, sparse, venn, venn_sql
from treelark.plans.registry import query
from treelark.sources.scratch import saved

EXPECTED = "ex AS (SELECT item_id AS case_id, d.doc_slug AS target FROM benchmark b JOIN d ON contains(d.raw_text, b.text))"
GAIN = "(ln({x} + 1) / ln(2.0::DOUBLE))"


def expected(m: Model) -> DataFrame:
    """(case_id, target): the documents that hold a benchmark passage, saved."""
    b = m.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("pattern"))
    found = se.holding(b, m.docs.select("doc_slug", "raw_text"), ["raw_text"], lambda c: F.contains(F.col(c), F.col("pattern")), key="doc_slug")
    return saved(found.select(F.col("query_id").alias("case_id"), F.col("doc_slug").alias("target")), "expected")


def configs(m: Model) -> DataFrame:
    """(config, case_id, rank, path) of all configurations."""
    q, c = m.search_queries, m.chunks
    dense = se.dense_top(q, m.embedded, 10).select(F.lit("dense").alias("config"), F.col("query_id").alias("case_id"), F.col("dense_rank").alias("rank"), "path")
    one = lambda name, hits, rank: hits.where(F.col(rank) <= 10).select(F.lit(name).alias("config"), F.col("query_id").alias("case_id"), F.col(rank).alias("rank"), "path")
    parts = [
        dense, one("sparse", se.sparse_top(q, c), "sparse_rank"), one("sparse_verbatim", se.sparse_top(q, c, text="verbatim_text"), "sparse_rank"),
        one("rrf", hybrid(m), "rank"), one("rrf_rerank", reranked(m), "new_rank"), venn(m).select(F.lit("venn").alias("config"), F.col("query_id").alias("case_id"), "rank", "path"),
        venn_reranked(m).select(F.lit("venn_rerank").alias("config"), F.col("query_id").alias("case_id"), "rank", "path"),
    ]
    return saved(reduce(DataFrame.unionByName, parts), "runs")


def venn_reranked(m: Model) -> DataFrame:
    semantic = reranked(m).select("query_id", "path", F.col("new_rank").alias("rank"))
    return se.venn(semantic, se.grep_page(grep(m), 10))


def light(m: Model) -> DataFrame:
    """Two configurations, for the metrics by themselves."""
    q, c = m.search_queries, m.chunks
    a = se.sparse_top(q, c).where("sparse_rank <= 10").select(F.lit("sparse").alias("config"), F.col("query_id").alias("case_id"), F.col("sparse_rank").alias("rank"), "path", F.lit("semantic_only").alias("found_in"))
    b = se.grep_page(grep(m), 10).select(F.lit("grep").alias("config"), F.col("query_id").alias("case_id"), "rank", "path", F.lit("verbatim_only").alias("found_in"))
    return saved(a.unionByName(b), "runs")


LIGHT = f"""WITH {C}, q AS (SELECT item_id AS query_id, array_to_string(regexp_split_to_array(text, '\\s+'), ' ') AS query_text FROM benchmark), {sparse('contextualized_text')}, {EXPECTED},
 hits AS (SELECT query_id, c.* FROM q JOIN c ON query_text <> '' AND (contains(verbatim_text, query_text) OR contains(contextualized_text, query_text))),
 run AS (SELECT 'sparse' AS config, query_id AS case_id, sparse_rank AS rank, path FROM sparse WHERE sparse_rank <= 10 UNION ALL
  SELECT 'grep', query_id, r, path FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY doc_slug, start_line, path) AS r FROM hits) WHERE r <= 10)"""


def outcome_sql(run: str = "run") -> str:
    return f"""cov AS (SELECT g.config, ex.case_id, ex.target, min(r.rank) AS first FROM (SELECT DISTINCT config FROM {run}) g JOIN ex ON true LEFT JOIN {run} r ON r.config = g.config AND r.case_id = ex.case_id AND (r.path = target OR starts_with(r.path, target || '.')) GROUP BY ALL),
 oc0 AS (SELECT config, case_id, count(*) AS n, count(first) = count(*) AS found, CASE WHEN count(first) = count(*) AND max(first) <= 10 THEN max(first) END AS rank_10, count(*) FILTER (WHERE first <= 5) AS in5, count(*) FILTER (WHERE first <= 10) AS in10,
  coalesce(sum(1.0::DOUBLE / {GAIN.format(x='first')}) FILTER (WHERE first <= 10), 0) AS dcg FROM cov GROUP BY ALL),
 oc AS (SELECT config, case_id, found, rank_10, coalesce(rank_10 <= 1, false) AS hit_1, coalesce(rank_10 <= 5, false) AS hit_5, coalesce(rank_10 <= 10, false) AS hit_10, round(in5::DOUBLE / n, 6) AS recall_5, round(in10::DOUBLE / n, 6) AS recall_10,
  round(coalesce(1.0::DOUBLE / rank_10, 0), 6) AS mrr_10, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / {GAIN.format(x='i')})), 6) AS ndcg_10 FROM oc0)"""


def outcomes(m: Model) -> DataFrame:
    return ev.outcomes(light(m), expected(m))


@query("ev_match", f"WITH {C}, {EXPECTED} SELECT case_id, target, count(*) AS paths FROM ex JOIN c ON c.path = target OR starts_with(c.path, target || '.') GROUP BY ALL")
def ev_match(m: Model) -> DataFrame:
    from treelark.functions.paths import ancestors

    up = m.chunks.select("path", F.explode(ancestors(F.col("path"), with_self=True)).alias("target"))
    return up.join(expected(m), "target").groupBy("case_id", "target").agg(F.count("*").alias("paths"))


CHANNEL = "CASE WHEN NOT found THEN 'missed' WHEN config = 'grep' THEN 'verbatim_only' ELSE 'semantic_only' END AS found_in"


@query("ev_completion", f"{LIGHT}, {outcome_sql()}, la AS (SELECT config, case_id, max(first) AS last FROM cov GROUP BY ALL) SELECT oc.config, oc.case_id, found, rank_10, {CHANNEL.replace('config', 'oc.config')}, CASE WHEN found THEN path END AS matched_path FROM oc JOIN la USING (config, case_id) LEFT JOIN run r ON r.config = oc.config AND r.case_id = oc.case_id AND r.rank = last")
def ev_completion(m: Model) -> DataFrame:
    return outcomes(m).select("config", "case_id", "found", "rank_10", "found_in", "matched_path")


@query("ev_hit_recall_mrr", f"{LIGHT}, {outcome_sql()} SELECT config, case_id, hit_1, hit_5, hit_10, recall_5, recall_10, mrr_10 FROM oc")
def ev_hit_recall_mrr(m: Model) -> DataFrame:
    return outcomes(m).select("config", "case_id", "hit_1", "hit_5", "hit_10", "recall_5", "recall_10", "mrr_10")


@query("ev_ndcg_binary", f"{LIGHT}, {outcome_sql()} SELECT config, case_id, ndcg_10 FROM oc")
def ev_ndcg_binary(m: Model) -> DataFrame:
    """By the greedy fold over each case's ranked array."""
    hits, ex = light(m), expected(m)
    ranked = hits.groupBy("config", "case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("ranked"))
    targets = ex.groupBy("case_id").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    joined = ev.each_config(hits, targets).join(ranked, ["config", "case_id"], "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    return joined.select("config", "case_id", ev.ndcg_binary(F.col("ranked"), F.col("targets")).alias("ndcg_10"))


@query("ev_ndcg_graded", f"""WITH {RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, rank) AS best FROM runs)
 SELECT case_id, round(sum((pow(2.0, relevance) - 1) / {GAIN.format(x='rank')}), 6) AS dcg, round(coalesce(sum((pow(2.0, relevance) - 1) / {GAIN.format(x='rank')}) / nullif(sum((pow(2.0, relevance) - 1) / {GAIN.format(x='best')}), 0), 0), 6) AS ndcg FROM b GROUP BY case_id""")
def ev_ndcg_graded(m: Model) -> DataFrame:
    return ev.ndcg_graded(m.runs)


@query("ev_strict_lenient", f"""WITH {RUNS}, f AS (SELECT case_id, min(rank) FILTER (WHERE relevance = 2) AS strict, min(rank) FILTER (WHERE relevance >= 1) AS lenient FROM runs GROUP BY case_id), l AS (SELECT 'strict' AS level, strict AS first FROM f UNION ALL SELECT 'lenient', lenient FROM f)
 SELECT level, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM l GROUP BY level""")
def ev_strict_lenient(m: Model) -> DataFrame:
    return ev.strict_lenient(m.runs)


@query("ev_batch_breakdown", f"WITH {RUNS}, b AS (SELECT case_id, max(relevance) AS best FROM runs GROUP BY case_id) SELECT case_id // 100 % 3 AS batch, count(*) AS total, count(*) FILTER (WHERE best = 2) AS best_2, count(*) FILTER (WHERE best = 1) AS best_1, count(*) FILTER (WHERE best = 0) AS best_0, round(count(*) FILTER (WHERE best = 2) / count(*)::DOUBLE, 6) AS strict_rate FROM b GROUP BY 1")
def ev_batch_breakdown(m: Model) -> DataFrame:
    return ev.batch_breakdown(m.runs, F.floor(F.col("case_id") / 100) % 3)


REPORT = f"""WITH {RUNS}, f AS (SELECT case_id, min(rank) FILTER (WHERE relevance = 2) AS s, min(rank) FILTER (WHERE relevance >= 1) AS l FROM runs GROUP BY case_id), t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, rank) AS best FROM runs WHERE rank <= 5),
 nd AS (SELECT case_id, coalesce(sum((pow(2.0, relevance) - 1) / {GAIN.format(x='rank')}) / nullif(sum((pow(2.0, relevance) - 1) / {GAIN.format(x='best')}), 0), 0) AS g FROM t GROUP BY case_id),
 a AS (SELECT count(*) AS n, count(*) FILTER (WHERE s <= 1) AS s1, count(*) FILTER (WHERE s <= 3) AS s3, count(*) FILTER (WHERE s <= 5) AS s5, count(*) FILTER (WHERE l <= 1) AS l1, count(*) FILTER (WHERE l <= 3) AS l3, count(*) FILTER (WHERE l <= 5) AS l5, avg(coalesce(1.0::DOUBLE / s, 0)) AS ms, avg(coalesce(1.0::DOUBLE / l, 0)) AS ml FROM f),
 h AS (SELECT *, unnest([1, 3, 5]) AS k, unnest([s1, s3, s5]) AS sk, unnest([l1, l3, l5]) AS lk, unnest(['direct', 'partial', 'missed']) AS v, unnest([s5, l5 - s5, n - l5]) AS c FROM a),
 b AS (SELECT case_id // 100 % 3 AS batch, max(relevance) AS best FROM t GROUP BY case_id)
 SELECT 1 AS part, printf('| Hit@%d | %.4f (%d/%d) | %.4f (%d/%d) |', k, sk / n::DOUBLE, sk, n, lk / n::DOUBLE, lk, n) AS line FROM h UNION ALL SELECT 1, printf('| MRR | %.4f | %.4f |', ms, ml) FROM a UNION ALL SELECT 1, printf('| nDCG@5 | - | %.4f |', (SELECT avg(g) FROM nd))
 UNION ALL SELECT 2, printf('| %s | %d | %.4f |', v, c, c / n::DOUBLE) FROM h
 UNION ALL SELECT 3, printf('| %d | %d | %d | %d | %d | %.4f |', batch, count(*), count(*) FILTER (WHERE best = 2), count(*) FILTER (WHERE best = 1), count(*) FILTER (WHERE best = 0), count(*) FILTER (WHERE best = 2) / count(*)::DOUBLE) FROM b GROUP BY batch"""


@query("ev_report", REPORT)
def ev_report(m: Model) -> DataFrame:
    """The lines of a Markdown report: rates, verdicts and batches."""
    return ev.report(m.runs, F.floor(F.col("case_id") / 100) % 3)


CASES = f"cases AS (SELECT oc.*, {CHANNEL}, ['none', 'low', 'medium', 'high'][case_id % 4 + 1] AS confidence, CASE WHEN case_id % 2 = 0 THEN 'dev' ELSE 'test' END AS test_set, 'd' || (case_id % 3) AS domain, (5 + (case_id * 37) % 101)::DOUBLE AS latency_ms FROM oc)"


def cases(m: Model) -> DataFrame:
    """Outcomes with a test set, a domain, a confidence and a latency by rule."""
    k = F.col("case_id")
    level = F.element_at(F.array(*[F.lit(x) for x in ev.LEVELS]), (k % 4 + 1).cast("int"))
    return outcomes(m).withColumns({"confidence": level, "test_set": F.when(k % 2 == 0, "dev").otherwise("test"), "domain": F.concat(F.lit("d"), (k % 3).cast("string")), "latency_ms": (5 + (k * 37) % 101).cast("double")})


_PCT = ", ".join(f"round(avg({c}::DOUBLE) * 100, 4) AS {c}" for c in ("found", "hit_1", "hit_5", "hit_10", "recall_5", "recall_10", "mrr_10", "ndcg_10"))
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {n}_{v}" for c, n, values in (("found_in", "channel", ("both", "semantic_only", "verbatim_only", "missed")), ("confidence", "confidence", ("none", "low", "medium", "high"))) for v in values)
MEASURES = f"count(*) AS n, {_PCT}, round(avg(latency_ms), 4) AS mean_ms, round(median(latency_ms), 4) AS median_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, {_COUNTS}"


@query("ev_summary", f"{LIGHT}, {outcome_sql()}, {CASES} SELECT config, {MEASURES} FROM cases GROUP BY config")
def ev_summary(m: Model) -> DataFrame:
    return ev.summary(cases(m), "config")


@query("ev_group_summary", f"{LIGHT}, {outcome_sql()}, {CASES} SELECT config, test_set, domain, {MEASURES} FROM cases GROUP BY GROUPING SETS ((config), (config, test_set), (config, domain), (config, test_set, domain))")
def ev_group_summary(m: Model) -> DataFrame:
    return ev.group_summary(cases(m))


BINOMIAL = "CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))))), 6) END"


@query("ev_mcnemar", f"""{LIGHT}, {outcome_sql()}, l AS (SELECT config, case_id, unnest(['found', 'hit_1', 'hit_5']) AS metric, unnest([found, hit_1, hit_5]) AS ok FROM oc),
 pr AS (SELECT metric, x.config AS config_a, y.config AS config_b, count(*) FILTER (WHERE x.ok AND NOT y.ok) AS b, count(*) FILTER (WHERE y.ok AND NOT x.ok) AS c FROM l x JOIN l y USING (case_id, metric) WHERE x.config < y.config GROUP BY ALL)
 SELECT metric, config_a, config_b, b AS better, c AS worse, {BINOMIAL} AS p FROM pr""")
def ev_mcnemar(m: Model) -> DataFrame:
    return ev.mcnemar(outcomes(m))


FLAT = f"{VENN}, fl AS (SELECT query_id, path, found_in, rank AS o FROM venn)"


@query("ev_flatten", f"{FLAT} SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY CASE found_in WHEN 'both' THEN 0 WHEN 'semantic_only' THEN 1 ELSE 2 END, o, path) AS rank FROM fl")
def ev_flatten(m: Model) -> DataFrame:
    return ev.flatten_venn(venn(m).withColumnRenamed("rank", "o"))


@query("ev_top_candidates", f"{VENN} SELECT query_id, path, found_in, rank AS place FROM venn WHERE rank <= 5")
def ev_top_candidates(m: Model) -> DataFrame:
    return ev.top_candidates(venn(m))


@query("ev_top_hits", f"{VENN}, {EXPECTED} SELECT query_id, rank, found_in, start_line, substr(verbatim_text, 1, 240) AS snippet, EXISTS (SELECT 1 FROM ex WHERE ex.case_id = query_id AND starts_with(c.path, target || '.')) AS matched FROM venn JOIN c USING (path) WHERE rank <= 10")
def ev_top_hits(m: Model) -> DataFrame:
    targets = expected(m).groupBy("case_id").agg(F.collect_set("target").alias("t"))
    hits = se.with_texts(venn(m).where("rank <= 10"), m.chunks.select("path", "start_line", "verbatim_text")).join(targets, F.col("query_id") == F.col("case_id"), "left")
    return hits.select("query_id", "rank", "found_in", "start_line", F.substring("verbatim_text", 1, 240).alias("snippet"), F.coalesce(F.exists("t", lambda t: ev.matches(F.col("path"), t)), F.lit(False)).alias("matched"))


@query("ev_case_edit", "WITH e AS (SELECT item_id AS case_id, CASE WHEN item_id % 3 = 0 THEN 'edited' ELSE 'first' END AS note FROM benchmark WHERE item_id % 5 <> 0) SELECT * FROM e")
def ev_case_edit(m: Model) -> DataFrame:
    b = m.table("benchmark").select(F.col("item_id").alias("case_id"), F.lit("first").alias("note"))
    return ev.edit_cases(b, b.where("case_id % 3 = 0").withColumn("note", F.lit("edited")), b.where("case_id % 5 = 0"))


_CUT = "query_id AS case_id, {rank} AS rank, path FROM {of} WHERE {rank} <= 10"
_RUN = " UNION ALL ".join(f"SELECT '{name}' AS config, {_CUT.format(of=of, rank=rank)}" for name, of, rank in (
    ("dense", "dense", "dense_rank"), ("sparse", "sparse", "sparse_rank"), ("sparse_verbatim", "sv", "sparse_rank"), ("rrf", "rrf", "rank"), ("rrf_rerank", "rr", "new_rank"))
)
_VENNS = " UNION ALL ".join(f"SELECT '{name}' AS config, query_id AS case_id, rank, path FROM {of}" for name, of in (("venn", "ve"), ("venn_rerank", "vr")))
ABLATION = f"""{PLAIN_ORDER}, {VERBATIM}, {EXPECTED}, sv AS (WITH {sparse('verbatim_text')} SELECT * FROM sparse),
ve AS (WITH {venn_sql("SELECT query_id, path, rank AS s FROM rrf WHERE rank <= 10")} SELECT * FROM venn), vr AS (WITH {venn_sql("SELECT query_id, path, new_rank AS s FROM rr WHERE new_rank <= 10")} SELECT * FROM venn),
run AS ({_RUN} UNION ALL {_VENNS}), {outcome_sql()}
SELECT config, count(*) AS n, round(avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS found, round(avg(mrr_10), 6) AS mrr_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM oc GROUP BY config"""


@query("ev_ablation", ABLATION)
def ev_ablation(m: Model) -> DataFrame:
    """Seven configurations over all cases, summed up by configuration."""
    return ev.outcomes(configs(m), expected(m)).groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(F.col("found").cast("double")), 6).alias("found"), F.round(F.avg("mrr_10"), 6).alias("mrr_10"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"))

