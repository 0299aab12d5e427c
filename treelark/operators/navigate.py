"""Navigation in the tree of paths, for batches of anchors. Prefix joins are equi joins on ancestors, behind the runs of path_store where rows are sought under anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelark.functions.paths import ancestors, humanise, is_under, nlevel, parent_path
from treelark.operators.path_store import below

#: Rows and bytes of anchors that may be sent to all tasks.
SENT_ROWS, SENT_BYTES = 1 << 20, 64 << 20


def relative(df: DataFrame) -> DataFrame:
    return df.withColumn("relative_depth", nlevel(F.col("path")) - nlevel(F.col("anchor")))


def children(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(anchor, path, ...): the chunks one level below each anchor."""
    c = chunks.withColumn("anchor", parent_path(F.col("path")))
    return relative(anchors.select("anchor").join(c, "anchor"))


def parent_chain(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The strict ancestors of each anchor that are chunks; relative_depth is negative, the root has the least."""
    up = anchors.select("anchor", F.explode(ancestors(F.col("anchor"))).alias("path"))
    return relative(up.join(chunks, "path"))


def siblings(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The other chunks below the parent of each anchor, at relative depth 0.

    What comes out is anchors times siblings, so nothing is made anew for a row of it. A row meets the anchors of its parent where it is read, if these
    are few enough to be sent out: a parent with very many children is then spread over all tasks.
    """
    a = anchors.select("anchor", parent_path(F.col("anchor")).alias("__p")).where("__p is not null")
    c = chunks.withColumn("__p", parent_path(F.col("path"))).where("__p is not null")
    n, size = a.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("anchor") + F.octet_length("__p")), F.lit(0))).first()
    few = F.broadcast(a) if n <= SENT_ROWS and size <= SENT_BYTES else a
    return c.join(few, "__p").where("path <> anchor").select("anchor", *chunks.columns, F.lit(0).cast("long").alias("relative_depth"))


def subtree(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """All strict descendants of each anchor; chunks sorted by path are read where the anchors' runs lie."""
    return relative(below(anchors.select("anchor"), chunks))


def virtual_parents(anchors: DataFrame) -> DataFrame:
    """Ancestors made up from titles for anchors (anchor, ancestor_titles, doc_level, end_line) that have none stored.

    One row a level from the document on: heading, bracketed breadcrumb, lines 1 to the anchor's end, negative depth.
    """
    level = nlevel(F.col("anchor"))
    rows = anchors.where(level > F.col("doc_level")).select("*", F.explode(F.sequence(F.col("doc_level").cast("int"), (level - 1).cast("int"))).alias("k"))
    nth = F.greatest(F.lit(1), F.least(F.col("k") - F.col("doc_level").cast("int") + 1, F.size("ancestor_titles")))
    title = F.coalesce(F.try_element_at("ancestor_titles", nth.cast("int")), F.lit(""))
    crumbs = F.array_join(F.slice("ancestor_titles", F.lit(1), nth.cast("int")), " > ")
    path = F.array_join(F.slice(F.split("anchor", r"\."), F.lit(1), F.col("k")), ".")
    kind = F.when(F.col("k") == F.col("doc_level"), "DOCUMENT").otherwise("SECTION")
    return rows.select("anchor", F.sha1(F.concat_ws(":", "anchor", path)).alias("id"), path.alias("path"), title.alias("verbatim_text"), F.concat(F.lit("["), crumbs, F.lit("]\n"), title).alias("contextualized_text"), F.lit(1).cast("long").alias("start_line"), F.col("end_line").cast("long"), kind.alias("node_type"), (F.col("k") - level).cast("long").alias("relative_depth"))


def resolve_anchors(requests: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requests (request_id, raw) -> anchor path, or an error.

    Priority 0: a chunk path. 1: a document slug that is a run of labels of the raw path (earliest start, longest first), then its first
    chunk at or under the path from that label on, else its first chunk. 2: a slug that starts with or holds the last labels of the raw path as a run of its own.
    """
    exact = requests.join(chunks.select(F.col("path").alias("raw")).distinct(), "raw").select("request_id", F.lit(0).alias("pri"), F.lit(0).alias("s"), F.lit(0).alias("l"), F.col("raw").alias("anchor"))
    parts = F.split("raw", r"\.")
    starts = requests.select("request_id", "raw", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("s"))
    run_list = starts.select("request_id", "raw", "p", "s", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("s") + 1)).alias("l"))
    run_list = run_list.select("request_id", "s", "l", F.array_join(F.slice("p", F.col("s"), F.col("l")), ".").alias("doc_slug"), F.array_join(F.slice("p", F.col("s"), F.size("p")), ".").alias("rest"))
    first = Window.partitionBy("request_id", "s", "l").orderBy(F.desc("under"), "start_line", "path")
    hit = run_list.join(docs.select("doc_slug"), "doc_slug").join(chunks.select("doc_slug", "path", "start_line"), "doc_slug")
    hit = hit.withColumn("under", is_under(F.col("path"), F.col("rest"))).withColumn("n", F.row_number().over(first)).where("n = 1")
    by_slug = hit.select("request_id", F.lit(1).alias("pri"), "s", (-F.col("l")).alias("l"), F.col("path").alias("anchor"))
    tails = starts.select("request_id", "s", F.array_join(F.slice("p", F.col("s"), F.size("p")), ".").alias("tail"))
    slug = F.split("doc_slug", r"\.")
    runs = docs.select("doc_slug", slug.alias("p"), F.explode(F.sequence(F.lit(1), F.size(slug))).alias("a")).select("doc_slug", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("a") + 1)).alias("b"))
    near = runs.select("doc_slug", F.array_join(F.slice("p", F.col("a"), F.col("b")), ".").alias("tail")).distinct().join(tails, "tail")
    near = near.join(chunks.groupBy("doc_slug").agg(F.min_by("path", F.struct("start_line", "path")).alias("anchor")), "doc_slug")
    by_part = near.select("request_id", F.lit(2).alias("pri"), "s", F.when(F.col("doc_slug").startswith(F.col("tail")), 0).otherwise(1).alias("l"), "anchor")
    best = Window.partitionBy("request_id").orderBy("pri", "s", "l", "anchor")
    found = exact.unionByName(by_slug).unionByName(by_part).withColumn("n", F.row_number().over(best)).where("n = 1")
    return requests.select("request_id", "raw").join(found.select("request_id", "pri", "anchor"), "request_id", "left").select("request_id", "raw", "anchor", F.when(F.col("anchor").isNull(), "ANCHOR_NOT_FOUND").alias("error"))


def children_or_all(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Children; an anchor without direct children gets all its descendants with relative depth 1."""
    direct = children(anchors, chunks)
    rest = anchors.select("anchor").join(direct.select("anchor").distinct(), "anchor", "left_anti")
    under = chunks.withColumn("anchor", F.explode(ancestors(F.col("path")))).join(rest, "anchor")
    return direct.unionByName(relative(under).withColumn("relative_depth", F.lit(1).cast("long")))


def page(nodes: DataFrame, limit: int, *order: str | Column) -> DataFrame:
    """The first rows of each anchor, 1 to 50, with total and a flag of what was cut."""
    k = min(max(limit, 1), 50)
    w = Window.partitionBy("anchor")
    total = nodes.groupBy("anchor").agg(F.count("*").alias("total"))
    first = nodes.withColumn("nth", F.row_number().over(w.orderBy(*order)).cast("long")).where(F.col("nth") <= k)
    return first.join(total, "anchor").withColumn("truncated", F.col("total") > k)


def leaf_rows(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_path, leaf): a path that is a chunk is its own leaf, else each chunk under it; no rows if there is none. Nothing is gathered."""
    asked = paths.select("query_path").distinct()
    own = chunks.select(F.col("path").alias("query_path")).join(asked, "query_path", "left_semi").distinct()
    under = below(asked, chunks.select("path"), "query_path").join(own, "query_path", "left_anti")
    return under.select("query_path", F.col("path").alias("leaf")).unionByName(own.select("query_path", F.col("query_path").alias("leaf")))


def expand_leaves(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_path, leaves): a path that is a chunk is its own leaf, else all chunks under it in order; none give an empty list."""
    hit = below(paths.select("query_path").distinct(), chunks.select("path"), "query_path", with_self=True).groupBy("query_path").agg(F.max(F.col("path") == F.col("query_path")).alias("exact"), F.sort_array(F.collect_list("path")).alias("all"))
    leaves = F.when(F.col("exact"), F.array("query_path")).otherwise(F.col("all"))
    return paths.select("query_path").distinct().join(hit, "query_path", "left").select("query_path", F.coalesce(leaves, F.array().cast("array<string>")).alias("leaves"))


def tree_nodes(chunks: DataFrame) -> DataFrame:
    """Every node of the trees of chunks (doc_slug, path, title, start_line, end_line and, if known, is_table and node_type), containers included.

    A container's span is from the least start to the greatest end below it; its label is its humanised last segment. A leaf has the
    node_type of its chunk, else TABLE or PARAGRAPH.
    """
    given = F.col("node_type") if "node_type" in chunks.columns else F.lit(None).cast("string")
    table = F.coalesce(F.col("is_table"), F.lit(False)) if "is_table" in chunks.columns else F.lit(False)
    leaf = F.coalesce(given, F.when(table, "TABLE").otherwise("PARAGRAPH"))
    up = chunks.select("doc_slug", F.explode(ancestors(F.col("path"), with_self=True)).alias("node"), "path", "title", "start_line", "end_line", leaf.alias("leaf"))
    own = F.col("path") == F.col("node")
    by = up.groupBy("doc_slug", "node").agg(
        F.max(F.when(own, F.col("title"))).alias("own_title"), F.max(F.when(own, F.col("start_line"))).alias("own_start"), F.max(F.when(own, F.col("end_line"))).alias("own_end"),
        F.min(F.when(~own, F.col("start_line"))).alias("low"), F.max(F.when(~own, F.col("end_line"))).alias("high"), F.max(own).alias("is_chunk"), F.count_if(~own).alias("below"), F.max(F.when(own, F.col("leaf"))).alias("leaf"),
    )
    kind = F.when(nlevel(F.col("node")) == 1, "DOCUMENT").when((F.col("below") > 0) | ~F.col("is_chunk"), "SECTION").otherwise(F.col("leaf"))
    last = F.substring_index("node", ".", -1)
    return by.select("doc_slug", F.col("node").alias("path"), parent_path(F.col("node")).alias("parent_path"), F.coalesce("own_title", humanise(last)).alias("label"), kind.alias("node_type"), F.coalesce("own_start", "low").alias("start_line"), F.coalesce("own_end", "high").alias("end_line"), "is_chunk", "below")


def edge_counts(edges: DataFrame) -> DataFrame:
    """(path, n): incident edges of each path, both ends counted."""
    return edges.select(F.explode(F.array("source", "target")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
