"""Mixing sources by temperature.

Each source has a share p of the corpus tokens (words [^\\x20\\x09-\\x0D]+) and the weight p^a / sum p^a. The exponent a in [0, 1] is the
smallest for which no source is repeated more often than a limit relative to the source repeated least, or that for which the weights have a
target entropy; it is found by section search, with all candidates of a pass in one aggregate over the sources. The budget is given, or the
smallest that passes every source once in full. A source's budget is its whole passes and a part of one more.

The part is a prefix of a block permutation: the documents of a source fall into 2^k hashed blocks of about BLOCK_DOCS documents, a keyed bijection gives
each block its turn, blocks are taken in turn until the budget is spent, and only the block on the border is cut, by hashed order of its
documents. Token sums are pre-aggregated by block, so a hot source is never gathered: one window runs over the block sums of a source, one over
the documents of one block. What documents are joined with is one row a source: its passes, its border block and the cut in it.

Null source: a source of its own. Null and empty texts have no tokens and are passed as often as their source in full. A source without
tokens is passed once. Ties in hashed order go by doc_id and text. Repeated rows are rows of their own with equal fate on a border where
they tie. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelark.llm.common import Workspace, bounded

#: Documents of a block to aim at, and the bounds of the logarithm of the number of blocks of a source.
BLOCK_DOCS, LEAST_BITS, MOST_BITS = 1024, 8, 24
#: The key of the block permutation: an odd factor and an offset.
TURN = (0x2545F491, 0x9E37)
SECTIONS, PASSES = 64, 4
REPETITION_LIMIT = 2.0
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def tokens(text: str = "text") -> Column:
    return F.expr(f"coalesce(regexp_count(cast(`{text}` as string), '{WORD}'), 0)").cast("long")


def measures(sources: DataFrame, candidates: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: entropy of the weights in nats, and the ratio of the most to the least passes."""
    a = F.explode(F.array(*[F.lit(float(x)) for x in candidates])).alias("a")
    p = F.col("p")
    by = sources.where("p > 0").select("p", a).groupBy("a").agg(
        F.sum(F.pow(p, F.col("a"))).alias("z"), F.sum(F.pow(p, F.col("a")) * F.col("a") * F.log(p)).alias("e"),
        F.max(F.pow(p, F.col("a") - 1)).alias("most"), F.min(F.pow(p, F.col("a") - 1)).alias("least"),
    )
    return {r["a"]: (math.log(r["z"]) - r["e"] / r["z"], r["most"] / r["least"]) for r in by.collect()}


def exponent(sources: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None) -> float:
    """The smallest exponent in [0, 1] that keeps to the limit, or whose weights have an entropy of at most `entropy`."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / SECTIONS
        grid = [low + step * k for k in range(SECTIONS + 1)]
        found = measures(sources, grid)
        if not found:
            return 1.0
        ok = [a for a in grid if (found[a][1] <= repetition_limit + 1e-9 if entropy is None else found[a][0] <= entropy + 1e-12)]
        if not ok:
            return high
        if ok[0] == low:
            return low
        low, high = ok[0] - step, ok[0]
    return round(high, 6)


def source_plan(sized: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """By source: share, weight, budget, whole passes, the tokens of the part, and the bits of a block. sized: (skey, n_tokens)."""
    bits = F.greatest(F.lit(LEAST_BITS), F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.count("*") / BLOCK_DOCS)))).cast("int")
    sums = sized.groupBy("skey").agg(F.sum("n_tokens").alias("source_tokens"), bits.alias("bits"))
    total = sums.agg(F.sum("source_tokens")).first()[0] or 0
    sources = sums.withColumn("p", F.col("source_tokens") / F.lit(max(1, total)))
    a = exponent(sources, repetition_limit, entropy)
    z = sources.where("p > 0").agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / z).otherwise(0.0)
    sources = sources.withColumn("weight", weight)
    if budget is None:
        budget = sources.where("p > 0").agg(F.max(F.col("source_tokens") / F.col("weight"))).first()[0] or 0
    sources = sources.withColumn("budget", F.round(F.lit(float(budget)) * F.col("weight") + 1e-6).cast("long"))
    whole = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.greatest("source_tokens", F.lit(1)))).otherwise(1)
    return sources.withColumn("passes", whole.cast("long")).withColumn("part", F.col("budget") - F.col("passes") * F.col("source_tokens"))


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))


def turn_of(order: str = "order", bits: str = "bits") -> Column:
    """The turn of a document's block: its hash modulo 2^bits, by a bijection of these numbers."""
    return F.expr(f"pmod(pmod(`{order}`, shiftleft(1L, `{bits}`)) * {TURN[0]} + {TURN[1]}, shiftleft(1L, `{bits}`))")


def copies(ws: Workspace, docs: DataFrame, **target: float) -> DataFrame:
    """(row, n_tokens, weight, copies, block_rank, order) for every document: how often the mix passes it.

    target: repetition_limit, entropy and budget of source_plan.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key().alias("skey"), tokens().alias("n_tokens"),
                         F.xxhash64(F.lit(17), "doc_id", "text").alias("order"))
    sized = ws.save(packed.select("skey", "n_tokens", "order"), "mix-sized")
    plan = ws.save(source_plan(sized, **target), "mix-sources")
    placed = sized.join(bounded(plan.select("skey", "bits")), "skey").withColumn("block_rank", turn_of())
    sums = placed.groupBy("skey", "block_rank").agg(F.sum("n_tokens").alias("block_tokens"))
    turn = Window.partitionBy("skey").orderBy("block_rank")
    blocks = sums.withColumn("end", F.sum("block_tokens").over(turn)).withColumn("start", F.col("end") - F.col("block_tokens"))
    border = blocks.join(bounded(plan.select("skey", "part")), "skey").where("end > part").groupBy("skey").agg(F.min(F.struct("block_rank", "start", "part")).alias("b"))
    border = ws.save(border.select("skey", F.col("b.block_rank").alias("border"), "b.start", "b.part"), "mix-borders")
    within = Window.partitionBy("skey").orderBy("order")  # ties are taken or left together
    edge = placed.join(bounded(border), "skey").where("block_rank = border")
    edge = edge.withColumn("reach", F.col("start") + F.sum("n_tokens").over(within.rangeBetween(Window.unboundedPreceding, 0)))
    cut = edge.where("reach <= part").groupBy("skey").agg(F.max("order").alias("cut"))
    by_source = ws.save(plan.select("skey", "weight", "passes", "bits").join(border.select("skey", "border"), "skey", "left").join(cut, "skey", "left"), "mix-plan")
    found = packed.join(bounded(by_source), "skey").withColumn("block_rank", turn_of())
    more = F.col("border").isNotNull() & ((F.col("block_rank") < F.col("border")) | ((F.col("block_rank") == F.col("border")) & (F.col("order") <= F.col("cut"))))
    n = F.col("passes") + F.coalesce(more.cast("int"), F.lit(0))
    return found.select("row", "n_tokens", "weight", n.cast("long").alias("copies"), "block_rank", "order")


def mixed(ws: Workspace, docs: DataFrame, **target: float) -> DataFrame:
    """The mix itself: every document as often as it is passed, with the columns of docs."""
    found = copies(ws, docs, **target).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("pass")).select("row.*")
