"""Tables sorted by path, and the runs of rows below anchors in them.

What lies strictly under an anchor `a` is the run of paths from `a.` up to, but without, `a/`, as `/` is the character after the dot. In a table
that is stored in the order of its paths, an anchor therefore needs the row groups that its run meets and no others: the runs of a batch are
plain comparisons of the path column, which reach the scan. Which anchors a row belongs to is then found by an equi join.

Any table will do, sorted or not: order changes what is read, never what is found. Null anchors find nothing, repeated anchors find their rows
once each, and an empty batch or an empty table has no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelark.functions.paths import ancestors

#: Anchors whose runs are pushed to the scan one by one. A larger batch gets the one run from its least to its greatest anchor: it never grows on the driver.
MOST_RUNS = 64


def sort_by_path(chunks: DataFrame) -> DataFrame:
    """chunks in ranges of paths, each sorted: write this to get files and row groups with narrow bounds."""
    return chunks.repartitionByRange("path").sortWithinPartitions("path")


def runs_below(anchors: DataFrame, column: str, with_self: bool = False) -> tuple[Column, list[str] | None]:
    """A condition on path that all rows below (or at) the anchors meet, and the anchors themselves if they are few."""
    own, path = anchors.where(F.col(column).isNotNull()).select(column).distinct(), F.col("path")
    few = sorted(r[0] for r in own.limit(MOST_RUNS + 1).collect())
    if not few:
        return F.lit(False), few
    if len(few) > MOST_RUNS:
        first = F.col(column) if with_self else F.concat(column, F.lit("."))
        low, high = own.agg(F.min(first), F.max(F.concat(column, F.lit("/")))).first()
        return (path >= low) & (path < high), None
    inner = {a for a in few if any(a.startswith(b + ".") for b in few)}
    tops = [a for a in few if a not in inner]
    runs = reduce(or_, [(path >= a + ".") & (path < a + "/") for a in tops])
    return (runs | path.isin(tops) if with_self else runs), few


def below(anchors: DataFrame, chunks: DataFrame, column: str = "anchor", with_self: bool = False) -> DataFrame:
    """The rows of chunks strictly under the anchors (with_self: or at them), once for each row of anchors, whose columns come along.

    With few anchors a row is copied for those above it alone, else for every ancestor.
    """
    condition, few = runs_below(anchors, column, with_self)
    up = ancestors(F.col("path"), with_self)
    up = F.filter(up, lambda a: a.isin(few)) if few else up
    return chunks.where(condition).withColumn(column, F.explode(up)).join(anchors, column)
