"""Scoring of retrieval runs: completion rank, hits, recall, MRR, nDCG, summaries and paired significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelark.functions.paths import is_under


def matches(path: Column, target: Column) -> Column:
    """A path answers a target if it is that target or lies under it."""
    return is_under(path, target)


def matches_lenient(path: Column, slug: Column, suffix: Column) -> Column:
    """Inside a document, also paths that end with the suffix or hold it between dots."""
    inside = is_under(path, slug)
    dotted = F.concat(F.lit("."), path, F.lit("."))
    return inside & ((suffix == "") | F.contains(dotted, F.concat(F.lit("."), suffix, F.lit("."))))


def covered(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(config, case_id, target, first): the first rank that answers each target, null if none. hits: (config, case_id, rank, path)."""
    joined = hits.select("config", "case_id", "rank", "path").join(expected.select("case_id", "target"), "case_id").where(matches(F.col("path"), F.col("target")))
    first = joined.groupBy("config", "case_id", "target").agg(F.min("rank").alias("first"))
    return each_config(hits, expected.select("case_id", "target")).join(first, ["config", "case_id", "target"], "left")


def each_config(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """rows once for each configuration of hits; the configurations are one small array."""
    names = hits.agg(F.collect_set("config").alias("configs"))
    return rows.join(F.broadcast(names)).select(*rows.columns, F.explode("configs").alias("config"))


def outcomes(hits: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """By config and case: found, the channel and path of completion, completion rank, hits, recall, reciprocal rank and binary nDCG.

    Completion is the rank at which the last target is first covered; found looks at the whole list, the others at the top k. The channel is the
    found_in of that hit if hits have one, else semantic_only, and `missed` for a case that is not found.
    """
    cover = covered(hits, expected)
    by = cover.groupBy("config", "case_id").agg(
        F.count("*").alias("n"), F.count("first").alias("any"), F.max("first").alias("last"), F.sort_array(F.collect_set("target")).alias("targets"),
        F.count_if(F.col("first") <= 5).alias("in5"), F.count_if(F.col("first") <= k).alias("in10"),
    )
    channel = F.col("found_in") if "found_in" in hits.columns else F.lit("semantic_only")
    lists = hits.groupBy("config", "case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path", channel.alias("found_in")))).alias("hits"))
    by = by.join(lists, ["config", "case_id"], "left")
    whole = F.col("any") == F.col("n")
    done = F.when(whole & (F.col("last") <= k), F.col("last"))
    at = F.get(F.filter("hits", lambda h: h["rank"] == F.col("last")), F.lit(0))
    hit = lambda x: F.coalesce(done <= x, F.lit(False))
    ranked = F.coalesce(F.transform(F.filter("hits", lambda h: h["rank"] <= k), lambda h: h["path"]), F.array().cast("array<string>"))
    return by.select(
        "config", "case_id", whole.alias("found"), F.when(whole, at["found_in"]).otherwise("missed").alias("found_in"), F.when(whole, at["path"]).alias("matched_path"),
        done.alias("rank_10"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), hit(k).alias("hit_10"),
        F.round(F.col("in5") / F.col("n"), 6).alias("recall_5"), F.round(F.col("in10") / F.col("n"), 6).alias("recall_10"),
        F.round(F.coalesce(F.lit(1.0) / done, F.lit(0.0)), 6).alias("mrr_10"), ndcg_binary(ranked, F.col("targets"), k).alias("ndcg_10"),
    )


def ndcg_binary(ranked: Column, targets: Column, k: int = 10) -> Column:
    """nDCG of a ranked array of paths: each target counts once, taken greedily in rank order."""
    start = F.struct(F.lit(0.0).alias("dcg"), F.lit(1).alias("i"), targets.alias("left"))

    def step(acc: Column, path: Column) -> Column:
        hit = F.filter(acc["left"], lambda t: matches(path, t))
        gain = F.when(F.size(hit) > 0, F.lit(1.0) / (F.ln(acc["i"] + 1) / F.ln(F.lit(2.0)))).otherwise(0.0)
        rest = F.when(F.size(hit) > 0, F.array_except(acc["left"], F.slice(hit, 1, 1))).otherwise(acc["left"])
        return F.struct((acc["dcg"] + gain).alias("dcg"), (acc["i"] + 1).alias("i"), rest.alias("left"))

    dcg = F.aggregate(F.slice(ranked, 1, k), start, step)["dcg"]
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size(targets), F.lit(k))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / (F.ln(i + 1) / F.ln(F.lit(2.0))))
    return F.when(F.size(targets) == 0, 0.0).otherwise(F.round(dcg / ideal, 6))


def ndcg_graded(runs: DataFrame) -> DataFrame:
    """(case_id, dcg, ndcg): gains 2^relevance - 1 over log2(rank + 1); the ideal order is by relevance; 0 if it is 0."""
    best = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("relevance"), "rank"))
    gain = lambda at: (F.pow(F.lit(2.0), "relevance") - 1) / (F.ln(F.col(at) + 1) / F.ln(F.lit(2.0)))
    by = runs.withColumn("best", best).groupBy("case_id").agg(F.sum(gain("rank")).alias("dcg"), F.sum(gain("best")).alias("ideal"))
    return by.select("case_id", F.round("dcg", 6).alias("dcg"), F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 6).alias("ndcg"))


def strict_lenient(runs: DataFrame) -> DataFrame:
    """(level, hit_1, hit_3, hit_5, mrr) over all cases: strict counts relevance 2, lenient 1 and more."""
    first = runs.groupBy("case_id").agg(F.min(F.when(F.col("relevance") == 2, F.col("rank"))).alias("strict"), F.min(F.when(F.col("relevance") >= 1, F.col("rank"))).alias("lenient"))
    long = first.select(F.expr("stack(2, 'strict', strict, 'lenient', lenient) as (level, first)"))
    rate = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    return long.groupBy("level").agg(rate(1), rate(3), rate(5), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def batch_breakdown(runs: DataFrame, batch: Column) -> DataFrame:
    """By batch of cases: how many have a best relevance of 2, 1 and 0, and the strict rate."""
    best = runs.groupBy("case_id").agg(F.max("relevance").alias("best")).withColumn("batch", batch)
    n = lambda k: F.count_if(F.col("best") == k)
    return best.groupBy("batch").agg(F.count("*").alias("total"), n(2).alias("best_2"), n(1).alias("best_1"), n(0).alias("best_0"), F.round(n(2) / F.count("*"), 6).alias("strict_rate"))


RATES = ("found", "hit_1", "hit_5", "hit_10", "recall_5", "recall_10", "mrr_10", "ndcg_10")
CHANNELS = ("both", "semantic_only", "verbatim_only", "missed")
LEVELS = ("none", "low", "medium", "high")


def measures(cases: DataFrame) -> list[Column]:
    """Counts, rates in per cent, latency statistics, and counts by channel (found_in) and confidence where cases have them."""
    pct = lambda c: F.round(F.avg(F.col(c).cast("double")) * 100, 4).alias(c)
    kinds = [(c, values) for c, values in (("found_in", CHANNELS), ("confidence", LEVELS)) if c in cases.columns]
    counts = [F.count_if(F.col(c) == v).alias(f"{'channel' if c == 'found_in' else c}_{v}") for c, values in kinds for v in values]
    return [F.count("*").alias("n"), *[pct(c) for c in RATES], *latency(), *counts]


def summary(cases: DataFrame, *by: str) -> DataFrame:
    """The measures of outcomes with latency_ms, by any columns."""
    return cases.groupBy(*by).agg(*measures(cases))


def latency() -> list[Column]:
    return [F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.round(F.percentile("latency_ms", 0.5), 4).alias("median_ms"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95_ms")]


def group_summary(cases: DataFrame) -> DataFrame:
    """The measures by config alone, with test set, with domain, and with both."""
    by = ["config", "test_set", "domain"]
    sets = [[F.col(c) for c in own] for own in (by[:1], by[:2], [by[0], by[2]], by)]
    return cases.groupingSets(sets, *by).agg(*measures(cases))


def report(runs: DataFrame, batch: Column) -> DataFrame:
    """(part, line): the rows of a report on judged runs (case_id, rank, relevance): strict and lenient rates, the verdicts of the top five, and the batches."""
    first = lambda least, k: F.min(F.when((F.col("relevance") >= least) & (F.col("rank") <= k), F.col("rank")))
    by = runs.groupBy("case_id").agg(*[first(least, k).alias(f"{name}_{k}") for least, name in ((2, "strict"), (1, "lenient")) for k in (1, 3, 5, 1 << 30)])
    by = by.join(ndcg_graded(runs.where("rank <= 5")).select("case_id", "ndcg"), "case_id", "left")
    n = F.count("*")
    rate = lambda c: F.concat(F.format_string("%.4f", F.count(c) / n), F.lit(" ("), F.count(c).cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))
    mrr = lambda name: F.format_string("%.4f", F.avg(F.coalesce(F.lit(1.0) / F.col(f"{name}_{1 << 30}"), F.lit(0.0))))
    cells = lambda *x: F.concat(F.lit("| "), *[y for c in x for y in (c if isinstance(c, Column) else F.lit(c), F.lit(" | "))][:-1], F.lit(" |"))
    count = lambda c, title: cells(title, c.cast("string"), F.format_string("%.4f", c / n))
    lines = [cells(f"Hit@{k}", rate(f"strict_{k}"), rate(f"lenient_{k}")) for k in (1, 3, 5)] + [cells("MRR", mrr("strict"), mrr("lenient")), cells("nDCG@5", "-", F.format_string("%.4f", F.avg(F.coalesce("ndcg", F.lit(0.0)))))]
    verdicts = [count(F.count("strict_5"), "direct"), count(F.count("lenient_5") - F.count("strict_5"), "partial"), count(n - F.count("lenient_5"), "missed")]
    rows = F.array(*[F.struct(F.lit(part).alias("part"), x.alias("line")) for part, own in ((1, lines), (2, verdicts)) for x in own])
    head = by.agg(rows.alias("r")).select(F.explode("r").alias("x")).select("x.*")
    own = batch_breakdown(runs.where("rank <= 5"), batch)
    text = [F.col(c).cast("string") for c in ("batch", "total", "best_2", "best_1", "best_0")]
    return head.unionByName(own.select(F.lit(3).alias("part"), cells(*text, F.format_string("%.4f", "strict_rate")).alias("line")))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of discordant pairs, at most 1; 1 if there are none. Sums logarithms, so counts may be large."""
    n, k = b + c, F.least(b, c)

    def step(acc: Column, i: Column) -> Column:
        log_c = acc["log_c"] + F.when(i == 0, F.lit(0.0)).otherwise(F.ln((n - i + 1).cast("double")) - F.ln(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(log_c.alias("log_c"), (acc["sum"] + F.exp(log_c - n * F.ln(F.lit(2.0)))).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("sum")), step)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * total), 6))


def mcnemar(cases: DataFrame, metrics: tuple[str, ...] = ("found", "hit_1", "hit_5")) -> DataFrame:
    """(metric, config_a, config_b, better, worse, p) for all pairs of configurations; the pairs are joined by case."""
    long = cases.select("config", "case_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("ok")) for m in metrics])).alias("m")).select("config", "case_id", "m.*")
    a, b = long.select(F.col("config").alias("config_a"), "case_id", "metric", F.col("ok").alias("a")), long.select(F.col("config").alias("config_b"), "case_id", "metric", F.col("ok").alias("b"))
    pairs = a.join(b, ["case_id", "metric"]).where("config_a < config_b").groupBy("metric", "config_a", "config_b").agg(F.count_if(F.col("a") & ~F.col("b")).alias("better"), F.count_if(~F.col("a") & F.col("b")).alias("worse"))
    return pairs.withColumn("p", mcnemar_p(F.col("better"), F.col("worse")))


def flatten_venn(venn_hits: DataFrame) -> DataFrame:
    """One ranked list of a three-part result (query_id, path, found_in, o): both, semantic only, verbatim only; a path's first place counts."""
    order = F.when(F.col("found_in") == "both", 0).when(F.col("found_in") == "semantic_only", 1).otherwise(2)
    once = venn_hits.groupBy("query_id", "path").agg(F.min(F.struct(order.alias("b"), "o")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "path")
    return once.select("query_id", "path", F.row_number().over(w).cast("long").alias("rank"))


def top_candidates(venn_hits: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct paths of each query by rank, with the channel."""
    once = venn_hits.groupBy("query_id", "path").agg(F.min("rank").alias("rank"), F.min_by("found_in", "rank").alias("found_in"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "path")).cast("long")
    return once.withColumn("place", n).where(F.col("place") <= k).drop("rank")


def edit_cases(cases: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases after upserts (by key, all columns replaced) and deletes."""
    kept = cases.join(upserts.select(key), key, "left_anti").unionByName(upserts)
    return kept.join(deletes.select(key), key, "left_anti")
