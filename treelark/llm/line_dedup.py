"""Line dedup: repeated runs of lines, found by distributed prefix doubling, lose their later copies.

A document is the sequence of its \\n-split lines, and a suffix is a position (document, line). Ranks are built by prefix doubling: rank 0
names the line at a position, rank k + 1 names the pair of the ranks k at the position and 2^k lines on, so equal ranks k mean equal next
2^k lines. After each round only suffixes that share their rank with another one stay (an interval of the suffix array with a longest
common prefix of 2^k lines or more), as no other can start a repeated run; the rest of the array is never built. A run counts if it has at
least MIN_WORDS words. For a position, the run that starts (ends) there and just reaches MIN_WORDS words is named by the ranks of its first
and last 2^k lines, 2^k being the largest power within it. The suffixes of one such name are a longest-common-prefix interval: the
first in the order (doc_id, line) stays, the others are later copies. A maximal repeated run of enough words is exactly the union
of such runs inside it, so deleting all later copies deletes every maximal repeated run of lines wherever it stands a second
time or more, and nothing else. Intervals are minima by key with map-side combine; no group is gathered.

Lines are compared by 64-bit hashes of their bytes, names are 64-bit hashes of pairs. DataFrame functions only.

Null text: stays null, no lines deleted. Empty text: one blank line. Blank lines are lines of no words. A document may lose all lines: its
text becomes empty. Order ties (repeated rows, equal doc_id with equal text) are one document and share its fate; a null doc_id comes
first. Extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelark.llm.common import Workspace, sifted

MIN_WORDS = 50
SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"
LINES = "split(text, '\\n', -1)"


def count_words(line: str) -> Column:
    """Words of a line: its pieces between white space, without the empty ones at the ends."""
    return F.expr(f"size(filter(split({line}, '{SPACE}', -1), w -> w <> ''))")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__doc", F.xxhash64(F.lit(29), "doc_id", "text"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, at, line, words): one row a line; line is a hash."""
    lines = docs.where("text is not null").select(F.col("__doc").alias("doc"), "doc_id", F.expr(f"posexplode({LINES})").alias("at", "text"))
    return lines.select("doc", "doc_id", "at", F.xxhash64("text").alias("line"), count_words("text").alias("words"))


def repeated(ws: Workspace, rows: DataFrame, name: str, table: str) -> DataFrame:
    """The rows of a saved table whose name stands at two positions or more, saved.

    The repeated names are saved first: both sides of the join are then plain shuffles, so that the rows of one very common name
    (blank lines) are split over tasks by Spark's skew join.
    """
    twice = ws.save(rows.groupBy(name).agg(F.count("*").alias("__n")).where("__n > 1").select(name), f"{table}-names")
    return ws.save(rows.join(twice, name).select(*rows.columns), table)


def runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, doc_id, at, n): for each line the shortest run of enough words that starts there, and that which ends there.

    One sorted pass: a line that starts at word s asks, at s + min_words, for the first line that ends there or later; a line that
    ends at word e asks, at e - min_words, for the last line that starts there or earlier.
    """
    by_doc = Window.partitionBy("doc").orderBy("at")
    sums = lines.withColumn("end", F.sum("words").over(by_doc)).withColumn("start", F.col("end") - F.col("words"))
    ask = F.explode(F.array(
        F.struct(F.col("end").alias("key"), F.lit(1).alias("kind")),  # this line ends here
        F.struct((F.col("start") + min_words).alias("key"), F.lit(2).alias("kind")),  # who ends here or later?
        F.struct(F.col("start").alias("key"), F.lit(3).alias("kind")),  # this line starts here
        F.struct((F.col("end") - min_words).alias("key"), F.lit(4).alias("kind")),  # who starts here or earlier?
    ))
    events = sums.select("doc", "doc_id", "at", ask.alias("e")).select("doc", "doc_id", "at", "e.key", "e.kind")
    back = Window.partitionBy("doc").orderBy(F.col("key").desc(), F.col("kind") == 2, F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("doc").orderBy(F.col("key"), F.col("kind") == 4, F.col("at")).rowsBetween(Window.unboundedPreceding, 0)
    ends = events.where("kind < 3").withColumn("last", F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(back))
    starts = events.where("kind > 2").withColumn("first", F.last(F.when(F.col("kind") == 3, F.col("at")), ignorenulls=True).over(on))
    forward = ends.where("kind = 2 and last is not null").select("doc", "doc_id", "at", (F.col("last") - F.col("at") + 1).alias("n"))
    backward = starts.where("kind = 4 and first is not null and key >= 0").select("doc", "doc_id", F.col("first").alias("at"), (F.col("at") - F.col("first") + 1).alias("n"))
    return forward.union(backward).distinct()


def later_copies(ws: Workspace, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, first, last): disjoint stretches of lines to delete. docs: with __doc."""
    lines = ws.save(positions(docs).distinct(), "lines")
    rank = repeated(ws, lines.select("doc", "at", F.col("line").alias("rank")), "rank", "rank-0")
    ranks = [rank]
    busy = rank.select("doc").distinct()
    asked = runs(lines.join(busy, "doc", "left_semi"), min_words).withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int"))
    asked = ws.save(asked, "asked")
    most = asked.agg(F.max("k")).first()[0] or 0
    for k in range(1, most + 1):
        if ranks[-1].isEmpty():  # nothing that long is repeated
            break
        on = ranks[-1].select("doc", (F.col("at") - (1 << (k - 1))).alias("at"), F.col("rank").alias("next"))
        pairs = ws.save(ranks[-1].join(on, ["doc", "at"]).select("doc", "at", F.xxhash64(F.lit(k), "rank", "next").alias("rank")), "pairs")
        ranks.append(repeated(ws, pairs, "rank", f"rank-{k}"))
        ws.drop("pairs")
    array = None
    for k, r in enumerate(ranks):
        r = r.withColumn("k", F.lit(k))
        array = r if array is None else array.unionByName(r)

    tail = array.select("doc", "k", F.col("at").alias("tail"), F.col("rank").alias("tail_rank"))
    named = asked.join(array, ["doc", "k", "at"]).withColumn("tail", F.col("at") + F.col("n") - F.expr("cast(shiftleft(1, k) as int)"))
    named = named.join(tail, ["doc", "k", "tail"]).select("doc", F.struct("doc_id", "doc", "at").alias("place"), "n", F.xxhash64("n", "rank", "tail_rank").alias("name"))
    named = ws.save(named, "runs")
    first = ws.save(named.groupBy("name").agg(F.min("place").alias("original"), F.count("*").alias("copies")).where("copies > 1"), "originals")
    gone = named.join(first, "name").where("place <> original").select("doc", F.col("place.at").alias("first"), (F.col("place.at") + F.col("n") - 1).alias("last"))
    in_order = Window.partitionBy("doc").orderBy("first", "last")
    reach = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = gone.withColumn("fresh", F.when(F.coalesce(F.col("first") > reach + 1, F.lit(True)), 1).otherwise(0))
    islands = fresh.withColumn("island", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return ws.save(islands.groupBy("doc", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("doc", "first", "last"), "gone")


def dedup(ws: Workspace, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, spans): every document with its text without later copies, and the deleted stretches (first, last)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    gone = later_copies(ws, keyed(docs.select("doc_id", "text")), min_words)
    spans = ws.save(gone.groupBy(F.col("doc").alias("__doc")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), "spans")
    some, rest = sifted(keyed(packed), spans, "__doc")
    joined = some.join(spans, "__doc", "left").unionByName(rest.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    kept = f"""
        filter(transform(sequence(0, size(spans)), i -> struct(
            if(i = 0, 0, spans[i - 1].last + 1) as a,
            if(i = size(spans), size({LINES}), spans[i].first) as b)), s -> s.b > s.a)"""
    text = f"case when spans is null or text is null then text else array_join(flatten(transform({kept}, s -> slice({LINES}, s.a + 1, s.b - s.a))), '\\n') end"
    n_lines = f"coalesce(size({LINES}), 0)"
    none = "cast(array() as array<struct<first: int, last: int>>)"
    return joined.select("row", F.expr(text).alias("text"), F.expr(f"cast(case when text is null then 0 else {n_lines} end as bigint)").alias("n_lines"), F.expr(f"coalesce(spans, {none})").alias("spans"))


def oracle(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL: every run of lines that just reaches min_words words, from either end, compared by its text."""
    return f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
    ), counted AS (
        SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines
    ), sums AS (
        SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS s FROM counted
    ), asked AS (
        SELECT a.doc_id, a.pos AS first, min(b.pos) AS last FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.e >= a.s + {min_words} GROUP BY ALL
        UNION
        SELECT b.doc_id, max(a.pos), b.pos FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND a.s <= b.e - {min_words} GROUP BY b.doc_id, b.pos
    ), texts AS (
        SELECT r.doc_id, first, last, array_to_string(string_split(d.text, chr(10))[first:last], chr(10)) AS body FROM asked r JOIN documents d USING (doc_id)
    ), places AS (
        SELECT *, row_number() OVER (PARTITION BY body, last - first ORDER BY doc_id, first) AS nth FROM texts
    ), gone AS (
        SELECT DISTINCT l.doc_id, l.pos FROM counted l JOIN places p ON l.doc_id = p.doc_id AND p.nth > 1 AND l.pos BETWEEN p.first AND p.last
    ), result AS (
        SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
        FROM counted l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
    )
    SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_deleted, 0) AS n_deleted, sha256(r.text) AS text_sha256
    FROM documents d LEFT JOIN result r USING (doc_id)
    """
