"""Chunking and source queries over the documents, with headings, fences and tags put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.functions import paths as p
from treelark.functions.text import once
from treelark.operators import chunking as ch
from treelark.plans.model import EDGES, RELATION_ROWS, TREE, C, D, Model
from treelark.plans.registry import query
from treelark.sources import corpus
from treelark.sources.scratch import scratch_folder

MD = f"""WITH {D}, l0 AS (SELECT doc_slug, doc_id, unnest(string_split(raw_text, chr(10))) AS t, generate_subscripts(string_split(raw_text, chr(10)), 1) AS n FROM d),
md AS (SELECT doc_slug, doc_id, n, t, CASE WHEN n % 7 = 2 THEN '## Part ' || (n % 2) WHEN n % 7 = 4 THEN '### Piece' WHEN n % 7 = 6 THEN '#### Item ' || (n % 3) ELSE t END AS line, CASE WHEN n % 7 IN (2, 4, 6) THEN 1 + (n % 7) // 2 END AS level FROM l0)"""


def md(m: Model) -> DataFrame:
    """(doc_slug, n, line): the lines of the documents, with headings of three levels on every seventh line."""
    rows = ch.lines_of(m.docs)
    n = F.col("n")
    line = F.when(n % 7 == 2, F.concat(F.lit("## Part "), (n % 2).cast("string"))).when(n % 7 == 4, "### Piece").when(n % 7 == 6, F.concat(F.lit("#### Item "), (n % 3).cast("string")))
    return rows.withColumn("line", F.coalesce(line, F.col("line")))


def tree(m: Model) -> DataFrame:
    return ch.section_tree(ch.headings(md(m)))


PARENT = "pa AS (SELECT h.doc_slug, h.n, h.level, h.line, max(g.n) AS parent FROM md h LEFT JOIN md g ON g.doc_slug = h.doc_slug AND g.n < h.n AND g.level < h.level WHERE h.level IS NOT NULL GROUP BY ALL)"


@query("chk_section_tree", f"{MD}, {PARENT} SELECT doc_slug, n, level, parent FROM pa")
def chk_section_tree(m: Model) -> DataFrame:
    return tree(m).where("level is not null").select("doc_slug", "n", F.col("level").cast("long").alias("level"), "parent")


@query("chk_sections", f"{MD} SELECT doc_slug, n, max(CASE WHEN level IS NOT NULL THEN n END) OVER (PARTITION BY doc_slug ORDER BY n) AS section FROM md")
def chk_sections(m: Model) -> DataFrame:
    return tree(m).select("doc_slug", "n", "section")


LABELS = f"""{PARENT}, lb AS (SELECT doc_slug, n, level, parent, l || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS label, substr(line, level + 2) AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_slug, parent, l ORDER BY n) AS k
 FROM (SELECT *, lower(regexp_replace(substr(line, level + 2), '[^A-Za-z0-9]+', '_', 'g')) AS l FROM pa)))"""


@query("chk_label_disambiguate", f"{MD}, {LABELS} SELECT doc_slug, n, label FROM lb")
def chk_label_disambiguate(m: Model) -> DataFrame:
    heads = tree(m).where("level is not null").withColumn("label", ch.label_of(F.col("title")))
    return ch.disambiguate(heads).select("doc_slug", "n", "label")


PATHS = f"""{LABELS}, pt AS (SELECT a.doc_slug, a.n, a.level, a.doc_slug || coalesce('.' || g.label, '') || coalesce('.' || f.label, '') || '.' || a.label AS path, coalesce(g.title || ' > ', '') || coalesce(f.title || ' > ', '') || a.title AS crumbs
 FROM lb a LEFT JOIN lb f ON f.doc_slug = a.doc_slug AND f.n = a.parent LEFT JOIN lb g ON g.doc_slug = f.doc_slug AND g.n = f.parent)"""


@query("chk_breadcrumbs", f"{MD}, {PATHS} SELECT doc_slug, n AS section, path, crumbs FROM pt")
def chk_breadcrumbs(m: Model) -> DataFrame:
    return ch.section_paths(tree(m)).select("doc_slug", "section", "path", ch.breadcrumbs(F.col("titles")).alias("crumbs"))


EMIT = f"""{PATHS}, sx AS (SELECT *, coalesce(max(CASE WHEN level IS NOT NULL THEN n END) OVER (PARTITION BY doc_slug ORDER BY n), 0) AS s FROM md),
sp AS (SELECT doc_slug, s, min(n) FILTER (WHERE trim(line) <> '') AS a, max(n) FILTER (WHERE trim(line) <> '') AS b, count(*) FILTER (WHERE trim(line) <> '' AND level IS NULL) AS prose FROM sx GROUP BY ALL),
em AS (SELECT sp.doc_slug, coalesce(pt.path, sp.doc_slug || '.overview') AS path, string_agg(line, chr(10) ORDER BY sx.n) AS verbatim_text, a AS start_line, b AS end_line, coalesce(crumbs, 'Overview') AS crumbs FROM sp JOIN sx ON sx.doc_slug = sp.doc_slug AND sx.s = sp.s AND sx.n BETWEEN a AND b
 LEFT JOIN pt ON pt.doc_slug = sp.doc_slug AND pt.n = sp.s WHERE prose > 0 GROUP BY ALL)"""


def emitted(m: Model) -> DataFrame:
    t = tree(m)
    return ch.emit(t, ch.section_paths(t))


@query("chk_emit", f"{MD}, {EMIT} SELECT path, verbatim_text, '[' || crumbs || ']' || chr(10) || verbatim_text AS contextualized_text, start_line, end_line FROM em")
def chk_emit(m: Model) -> DataFrame:
    return emitted(m).select("path", "verbatim_text", "contextualized_text", "start_line", "end_line")


@query("chk_flags", f"{MD}, {EMIT} SELECT path, contains(verbatim_text, '```') AS has_code, contains(verbatim_text, '|') AS has_table FROM em")
def chk_flags(m: Model) -> DataFrame:
    return ch.flags(emitted(m)).select("path", "has_code", "has_table")


@query("chk_profile_stats", f"""WITH {C}, ln AS (SELECT source, CAST(sum(len(string_split(raw_text, chr(10)))) AS BIGINT) AS lines FROM d GROUP BY source), lv AS (SELECT *, len(string_split(path, '.')) AS level FROM c)
 SELECT source, count(*) AS chunks, count(DISTINCT doc_slug) AS documents, round(avg(contains(verbatim_text, '```')::INT) * 100, 4) AS code_pct, round(avg(contains(verbatim_text, '|')::INT) * 100, 4) AS table_pct, min(length(verbatim_text)) AS min_len,
 round(median(length(verbatim_text)), 4) AS median_len, round(avg(length(verbatim_text)), 4) AS mean_len, round(quantile_cont(length(verbatim_text), 0.95), 4) AS p95_len, max(length(verbatim_text)) AS max_len, min(level) AS min_level, round(median(level), 4) AS median_level, round(avg(level), 4) AS mean_level, max(level) AS max_level,
 any_value(lines) AS lines, round(any_value(lines) / count(*)::DOUBLE, 4) AS lines_per_chunk FROM lv JOIN ln USING (source) GROUP BY source""")
def chk_profile_stats(m: Model) -> DataFrame:
    lines = m.docs.where("raw_text is not null").groupBy("source").agg(F.sum(F.size(F.split("raw_text", "\n"))).alias("lines"))
    return ch.profile_stats(m.chunks, "source", lines)


def fenced(m: Model, fences: dict[int, str]) -> DataFrame:
    """Lines with fences at some places of every eleven."""
    line = F.col("line")
    for k, fence in fences.items():
        line = F.when(F.col("n") % 11 == k, fence).otherwise(line)
    return ch.lines_of(m.docs).withColumn("line", line)


NUMBERED = "l AS (SELECT doc_slug, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) AS n FROM d)"


@query("chk_code_fence", f"WITH {D}, {NUMBERED} SELECT doc_slug, n, n % 11 BETWEEN 3 AND 8 AS in_code FROM l")
def chk_code_fence(m: Model) -> DataFrame:
    return ch.mark_code(fenced(m, {3: "```js", 8: "```"})).select("doc_slug", "n", "in_code")


@query("chk_code_fence_exact", f"WITH {D}, {NUMBERED} SELECT doc_slug, n, n % 11 IN (3, 4, 5, 6, 7, 9, 10, 0) AS in_code FROM l WHERE n > 2")
def chk_code_fence_exact(m: Model) -> DataFrame:
    """Fences of other kinds and shorter ones inside blocks, and a longer one that closes."""
    fences = {3: "```js", 4: "```js", 5: "~~~", 7: "```", 9: "````", 10: "```", 0: "`````"}
    return ch.mark_code(fenced(m, fences).where("n > 2")).select("doc_slug", "n", "in_code")


def with_front_matter(m: Model) -> DataFrame:
    """Documents of even ids get a front matter block."""
    block = "\"\nlang: x\nlang: {0}\nrelated:\n  title: Next\n  links:\n    - a/{0}\n    - 'b'\ntitle: again\n---\n"
    tail = F.format_string(block.replace("{0}", "%1$s"), "lang")
    head = F.concat(F.lit("---\ntitle: \"T"), F.col("doc_id").cast("string"), tail, F.col("raw_text"))
    return m.docs.withColumn("raw_text", F.when(F.col("doc_id") % 2 == 0, head).otherwise(F.col("raw_text")))


@query("chk_frontmatter", f"WITH {D} SELECT doc_slug, 'T' || doc_id AS title, 'again' AS last_title, lang, 'a/' || lang || ',b' AS links FROM d WHERE doc_id % 2 = 0 AND raw_text IS NOT NULL")
def chk_frontmatter(m: Model) -> DataFrame:
    _, meta = ch.front_matter(ch.lines_of(with_front_matter(m)))
    return meta.select("doc_slug", "title", F.col("metadata")["title"].alias("last_title"), F.col("metadata")["lang"].alias("lang"), F.array_join("related_links", ",").alias("links"))


@query("chk_blank_comments", f"WITH {D}, l AS (SELECT doc_slug, unnest(string_split(raw_text, chr(10))) AS t, generate_subscripts(string_split(raw_text, chr(10)), 1) AS n FROM d) SELECT doc_slug, n, CASE n % 6 WHEN 1 THEN 'a --> ' || t WHEN 2 THEN 'before ' WHEN 3 THEN '' WHEN 4 THEN ' after' ELSE t END AS line FROM l")
def chk_blank_comments(m: Model) -> DataFrame:
    """On every six lines a comment of three, with a stray closing mark before it."""
    n, line = F.col("n"), F.col("line")
    wrapped = F.when(n % 6 == 1, F.concat(F.lit("a --> "), line)).when(n % 6 == 2, "before <!-- open").when(n % 6 == 3, "inside */}").when(n % 6 == 4, "close --> after").when(n % 6 == 5, F.concat(line, F.lit('<a id="x"></a>'))).otherwise(F.concat(line, F.lit("{/* y */}")))
    return ch.blank_comments(ch.lines_of(m.docs).withColumn("line", wrapped).withColumn("in_code", F.lit(False))).select("doc_slug", "n", "line")


SCOPES = {"AppOnly": "app", "PagesOnly": "pages"}


def scoped_lines(m: Model) -> DataFrame:
    n = F.col("n")
    line = F.when(n % 8 == 1, "<AppOnly>").when(n % 8 == 3, "</AppOnly>").when(n % 8 == 4, "<PagesOnly>").when(n % 8 == 6, "</PagesOnly>").otherwise(F.col("line"))
    return ch.track_scope(ch.lines_of(m.docs).withColumn("line", line), SCOPES)


@query("chk_scope_track", f"WITH {D}, l AS (SELECT doc_slug, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) AS n FROM d) SELECT doc_slug, n, CASE WHEN n % 8 IN (1, 2) THEN 'app' WHEN n % 8 IN (4, 5) THEN 'pages' END AS scope FROM l")
def chk_scope_track(m: Model) -> DataFrame:
    return scoped_lines(m).select("doc_slug", "n", "scope")


@query("chk_scope_markers", f"WITH {D}, {NUMBERED}, t AS (SELECT *, max(n) OVER (PARTITION BY doc_slug) AS top FROM l) SELECT doc_slug, n, top >= 3 AND n % 8 IN (1, 4) AS marked, CASE WHEN top < 3 THEN 'app' END AS section_scope FROM t")
def chk_scope_markers(m: Model) -> DataFrame:
    lines = scoped_lines(m).withColumn("line", F.concat("line", F.lit("x"))).withColumn("section", F.lit(1))
    marked = ch.insert_scope_markers(lines, {"app": "App Router", "pages": "Pages Router"})
    return marked.select("doc_slug", "n", F.contains("line", F.lit("Router]**")).alias("marked"), "section_scope")


@query("chk_markup_normalise", f"WITH {C} SELECT path, '**' || w || '** ✓ ![' || w || '](i>.png) x' AS line FROM (SELECT path, 'W' || trim(regexp_replace(regexp_replace(verbatim_text, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS w FROM c)")
def chk_markup_normalise(m: Model) -> DataFrame:
    """The words of every line inside component tags, one of them with `>` in an attribute."""
    w = F.concat(F.lit("W"), F.trim(F.regexp_replace(F.regexp_replace("verbatim_text", "[^A-Za-z0-9 ]", ""), " +", " ")))
    raw = once(w, lambda w: F.concat(F.lit("<summary> "), w, F.lit(' </summary> <Check size={1} /> <Image alt="'), w, F.lit('" src="i>.png" /> <b title="a > b">x</b>')))
    return m.chunks.select("path", ch.normalise_markup(raw).alias("line"))


@query("chk_comment_meta", f"WITH {D} SELECT doc_slug, '*Added in: ' || CASE WHEN doc_id % 3 = 0 THEN 'REPLACEME' ELSE 'v' || coalesce(length(raw_text), 0) || '.0.0-rc.1, v' || doc_id % 7 || '.1.0' END || CASE WHEN doc_id % 2 = 0 THEN ' — Deprecated in: v4.0.0' ELSE '' END || '*' AS badge, 'v' || doc_id AS introduced FROM d")
def chk_comment_meta(m: Model) -> DataFrame:
    k = F.col("doc_id")
    yaml = F.concat(F.lit("<!-- YAML\n"), F.when(k % 3 == 0, "added: REPLACEME\n").otherwise(F.concat(F.lit("added:\n  - v"), F.coalesce(F.char_length("raw_text"), F.lit(0)).cast("string"), F.lit(".0.0-rc.1\n  - v"), (k % 7).cast("string"), F.lit(".1.0\n"))), F.when(k % 2 == 0, "deprecated: v4.0.0\n").otherwise(""), F.lit("-->"))
    return m.docs.select("doc_slug", ch.version_badge(yaml).alias("badge"), ch.comment_value(F.concat(F.lit("<!-- introduced_in=v"), k.cast("string"), F.lit(" -->")), "introduced_in").alias("introduced"))


@query("chk_legal_normalise", f"WITH {D}, l AS (SELECT doc_slug, unnest(string_split(raw_text, chr(10))) AS t, generate_subscripts(string_split(raw_text, chr(10)), 1) AS n, len(string_split(raw_text, chr(10))) AS top FROM d) SELECT doc_slug, n, CASE n % 9 WHEN 2 THEN '### Tiểu mục ' || n || CASE WHEN n + 2 <= top THEN ': QUY' ELSE '' END WHEN 3 THEN '' WHEN 4 THEN '' ELSE trim(t) END AS line FROM l")
def chk_legal_normalise(m: Model) -> DataFrame:
    n = F.col("n")
    line = F.when(n % 9 == 2, F.concat(F.lit("Tiểu mục "), n.cast("string"))).when(n % 9 == 3, " ").when(n % 9 == 4, "QUY").otherwise(F.col("line"))
    return ch.normalise_statutes(ch.lines_of(m.docs).withColumn("line", line)).select("doc_slug", "n", F.trim("line").alias("line"))


@query("chk_legal_classify", f"WITH {D}, k AS (SELECT doc_id, lower(regexp_replace(strip_accents(regexp_extract(title, '[A-Za-z]+')), '[^A-Za-z]', '', 'g')) AS word, doc_id % 5 AS k FROM d) SELECT doc_id, CASE WHEN k = 4 THEN 5 ELSE 1 + k END AS level, CASE WHEN k = 4 THEN 'part_' || doc_id || CASE WHEN word <> '' THEN '_' || word ELSE '' END ELSE ['chuong_', 'muc_', 'tieu_muc_', 'dieu_'][k + 1] || doc_id END AS label, ['CHAPTER', 'SECTION', 'SUBSECTION', 'ARTICLE', 'SECTION'][k + 1] AS kind FROM k")
def chk_legal_classify(m: Model) -> DataFrame:
    """Headings made of a statute word, the document's id and the first word of its title."""
    word = F.element_at(F.array(F.lit("Chương "), F.lit("Mục "), F.lit("Tiểu mục "), F.lit("Điều "), F.lit("Part ")), (F.col("doc_id") % 5 + 1).cast("int"))
    k = ch.classify_statute(F.lit(5), F.concat(word, F.col("doc_id").cast("string"), F.lit(". "), F.coalesce(F.regexp_extract("title", "[A-Za-z]+", 0), F.lit(""))))
    return m.docs.select("doc_id", k["level"].cast("long").alias("level"), k["label"].alias("label"), k["kind"].alias("kind"))


UP = "(SELECT path, unnest(range(1, level + 1)) AS k FROM v)"


@query("chk_inherit", f"WITH {TREE}, v AS (SELECT path, level, CASE WHEN start_line % 3 = 0 THEN title END AS v FROM tree), u AS (SELECT a.path, arg_max(b.v, b.level) AS i FROM {UP} a JOIN v b ON b.path = array_to_string(string_split(a.path, '.')[1:k], '.') AND b.v IS NOT NULL GROUP BY a.path) SELECT v.path, u.i AS v_inherited FROM v LEFT JOIN u USING (path)")
def chk_inherit(m: Model) -> DataFrame:
    s = m.tree.select("path", F.when(F.col("start_line") % 3 == 0, F.col("title")).alias("v"))
    return ch.inherit(s, "v").select("path", "v_inherited")


@query("chk_prune_empty", f"WITH {TREE}, v AS (SELECT path, level, start_line % 97 = 0 AS has FROM tree) SELECT path FROM v WHERE path IN (SELECT array_to_string(string_split(path, '.')[1:k], '.') FROM (SELECT path, unnest(range(1, level + 1)) AS k FROM v WHERE has))")
def chk_prune_empty(m: Model) -> DataFrame:
    return ch.prune_empty(m.tree.select("path", (F.col("start_line") % 97 == 0).alias("has_prose"))).select("path")


@query("chk_label_sanitise", f"WITH {D}, w AS (SELECT doc_id, trim(w || ' ' || doc_id) AS r, k FROM d, unnest(string_split(title, ' ')) WITH ORDINALITY AS u(w, k)) SELECT doc_id, k AS word, rtrim(substr(trim(lower(regexp_replace(strip_accents(replace(replace(r, 'đ', 'd'), 'Đ', 'D')), '[^A-Za-z0-9_]+', '_', 'g')), '_'), 1, 250), '_') AS label FROM w")
def chk_label_sanitise(m: Model) -> DataFrame:
    """Every word of every title with the document's id, as a label."""
    words = m.docs.select("doc_id", F.posexplode(F.split("title", " ")).alias("k", "w"))
    return words.select("doc_id", (F.col("k") + 1).cast("long").alias("word"), p.sanitise_label(F.concat("w", F.lit(" "), F.col("doc_id").cast("string"))).alias("label"))


@query("chk_path_canon", f"WITH {D}, w AS (SELECT doc_id, source, trim(lower(regexp_replace(strip_accents(replace(replace('Part ' || regexp_extract(title, '[^ /.\\\\]+'), 'đ', 'd'), 'Đ', 'D')), '[^A-Za-z0-9_]+', '_', 'g')), '_') AS part FROM d) SELECT doc_id, source || '.doc_' || doc_id || '.' || part AS path FROM w")
def chk_path_canon(m: Model) -> DataFrame:
    first = F.regexp_extract("title", r"[^ /.\\]+", 0)
    raw = F.concat("source", F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit("\\ . Part "), F.coalesce(first, F.lit("")))
    return m.docs.select("doc_id", p.canonical_path(raw).alias("path"))


@query("chk_path_valid", f"WITH {C} SELECT path, start_line % 3 <> 0 AS valid FROM c")
def chk_path_valid(m: Model) -> DataFrame:
    tried = F.when(F.col("start_line") % 3 == 0, F.concat("path", F.lit(".-"))).otherwise(F.col("path"))
    return m.chunks.select("path", p.is_valid_path(tried).alias("valid"))


@query("chk_is_ancestor", f"WITH {TREE} SELECT path, starts_with(path, doc_slug || '.') AS below FROM tree")
def chk_is_ancestor(m: Model) -> DataFrame:
    return m.tree.select("path", p.is_strictly_under(F.col("path"), F.col("doc_slug")).alias("below"))


def calls(m: Model) -> DataFrame:
    """One heading a line: callables that change every third line; two of three are empty."""
    n = F.col("n")
    return ch.lines_of(m.docs).select("doc_slug", "n", F.lit(3).alias("level"), F.concat(F.lit("`fn"), F.floor((n - 1) / 3).cast("string"), F.lit("("), n.cast("string"), F.lit(")`")).alias("title"), (n % 3 != 0).alias("empty"))


@query("chk_fold_overloads", f"WITH {D}, {NUMBERED} SELECT doc_slug, max(n) AS target, min(n) AS start_line, count(*) AS n_titles FROM l GROUP BY doc_slug, (n - 1) // 3")
def chk_fold_overloads(m: Model) -> DataFrame:
    return ch.fold_overloads(calls(m)).select("doc_slug", "target", "start_line", F.size("titles").cast("long").alias("n_titles"))


@query("chk_fold_subheads", f"WITH {D}, {NUMBERED} SELECT doc_slug, n, n > 1 AND n % 5 IN (2, 3) AS folded FROM l")
def chk_fold_subheads(m: Model) -> DataFrame:
    """One heading a line: an entry, a parameter of it, prose, a unit of its own, and prose behind that."""
    n = F.col("n")
    title = F.element_at(F.array(F.lit("After"), F.lit("`open(path, flags)`"), F.lit("`path`"), F.lit("Example: use"), F.lit("`new Thing(x)`")), (n % 5 + 1).cast("int"))
    heads = ch.lines_of(m.docs).select("doc_slug", "n", F.when(n % 5 == 1, 3).otherwise(4).alias("level"), title.alias("title"))
    return ch.fold_subheads(heads).select("doc_slug", "n", "folded")


@query("chk_merge_pairs", f"WITH {D}, {NUMBERED}, t AS (SELECT *, max(n) OVER (PARTITION BY doc_slug) AS top FROM l) SELECT doc_slug, n, CASE WHEN n % 3 = 2 THEN n - 1 END AS merged_into, CASE WHEN n % 3 = 1 AND n < top THEN 's' || (n + 1) END AS label_title FROM t")
def chk_merge_pairs(m: Model) -> DataFrame:
    """One heading a line, of levels 4, 5 in code, and 3."""
    n = F.col("n")
    title = F.when(n % 3 == 1, "Describe").when(n % 3 == 2, F.concat(F.lit("`s"), n.cast("string"), F.lit("`"))).otherwise("Version")
    parent = F.when(n % 3 == 2, n - 1).when((n % 3 == 1) & (n > 1), n - 1)
    rows = ch.lines_of(m.docs).select("doc_slug", "n", F.when(n % 3 == 1, 4).when(n % 3 == 2, 5).otherwise(3).alias("level"), title.alias("title"), parent.alias("parent"))
    return ch.merge_pairs(rows).select("doc_slug", "n", "merged_into", "label_title")


def api_documents(m: Model) -> DataFrame:
    """The documents with headings, version comments, stability notes and code of an API put between their lines by rule."""
    put = {1: "# Module", 3: "<!-- YAML\nadded: v1.2.0\n-->\n> Stability: 2 - Stable", 4: "## `open(path[, flags])`", 6: "## `open(path, flags, mode)`", 8: "### `path`", 9: "### `open.sync(path)`", 11: "### Caveats", 10: "| `a` | <b>b</b> |", 12: "```js\n# no heading", 13: "```", 14: "## Class: `Thing`", 16: "### Event: `'end'`"}
    return _with_lines(m, put)


def mdx_documents(m: Model) -> DataFrame:
    """The documents with headings, scopes, components and code put between their lines by rule."""
    put = {1: "---\ntitle: Given\nrelated:\n  links:\n    - a\n---", 3: "## Use", 4: "<AppOnly>", 6: "</AppOnly>", 7: "## Use", 5: "Say `<Image>` or `<Link>`, <b>not</b> `a  b`.", 8: "{/* gone\n## not here */}", 11: "<Image",  9: "#### Rename the thing", 10: "##### `rename-thing`", 12: '<Image\n  alt="a > b"\n  src="/i.png"\n/>', 13: "```js\n<AppOnly>", 14: "```", 15: '<FixCardGrid>\n<FixCard title="T" href="/h" />\n</FixCardGrid>', 16: "<Check size={1} /> done"}
    return _with_lines(m, put)


def _with_lines(m: Model, put: dict[int, str]) -> DataFrame:
    """The documents with lines put before some of every seventeen."""
    table = F.create_map(*[F.lit(x) for kv in put.items() for x in kv])
    lines = F.transform(F.split("raw_text", "\n"), lambda t, i: F.concat(F.coalesce(F.concat(table[i % 17 + 1], F.lit("\n")), F.lit("")), t))
    return m.docs.where("raw_text is not null").select("doc_slug", F.array_join(lines, "\n").alias("raw_text"))


@query("chk_profile_nodejs", None)
def chk_profile_nodejs(m: Model) -> DataFrame:
    """The assembled profile of API documents; equal to a brute-force parser in the tests."""
    return ch.chunk_api(api_documents(m)).select("path", "verbatim_text", "contextualized_text", "start_line", "end_line", "node_type", "stability", "has_code", "has_table")


@query("chk_profile_nextjs", None)
def chk_profile_nextjs(m: Model) -> DataFrame:
    """The assembled profile of MDX documents; equal to a brute-force parser in the tests."""
    return ch.chunk_mdx(mdx_documents(m)).select("path", "verbatim_text", "contextualized_text", "start_line", "end_line", "node_type", "scope", F.array_join("related_links", ",").alias("links"))


def statute_documents(m: Model) -> DataFrame:
    """The documents as statutes: front matter, a preface, and every line of theirs as an item, with units and other headings before some of every twelve."""
    number = lambda i: (i + 1).cast("string")
    put = lambda i: F.element_at(F.array(F.concat(F.lit("## Chương "), (F.floor(i / 12) + 1).cast("string")), F.lit(""), F.concat(F.lit("### Mục "), number(i)), F.lit(""), F.concat(F.lit("#### Điều "), number(i)), F.lit(""), F.lit("##### Ghi chú"), F.lit(""), F.concat(F.lit("#### Điều "), number(i), F.lit("a")), F.lit(""), F.concat(F.lit("Tiểu mục "), number(i)), F.lit("")), i % 12 + 1)
    lines = F.transform(F.split("raw_text", "\n"), lambda t, i: F.concat(put(i), F.lit("\n\n– a "), t))
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("---\ntitle: T"), k, F.lit("\ndoc_code: C"), k, F.lit("\n---\nLời nói đầu\n"), F.array_join(lines, "\n"))
    return m.docs.where("raw_text is not null").select("doc_slug", text.alias("raw_text"))


LEGAL = f"""WITH {D}, l AS (SELECT doc_slug, doc_id, unnest(string_split(raw_text, chr(10))) AS t, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM d WHERE raw_text IS NOT NULL),
u AS (SELECT *, CASE i % 12 WHEN 1 THEN 'CHAPTER' WHEN 3 THEN 'SECTION' WHEN 5 THEN 'ARTICLE' WHEN 9 THEN 'ARTICLE' WHEN 11 THEN 'SUBSECTION' END AS unit, (i - 1) // 12 AS k FROM l),
s AS (SELECT *, max(CASE WHEN unit IS NOT NULL THEN i END) OVER (PARTITION BY doc_slug ORDER BY i) AS s FROM u),
b AS (SELECT doc_slug, doc_id, s, any_value(k) AS k, s % 12 AS r, max(unit) AS unit, string_agg(CASE WHEN i % 12 = 7 THEN '##### Ghi chú' || chr(10) || chr(10) ELSE '' END || rtrim('– a ' || t), chr(10) || chr(10) ORDER BY i) AS body, 5 + 3 * s - 2 AS start_line, 5 + 3 * max(i) AS end_line FROM s GROUP BY doc_slug, doc_id, s),
h AS (SELECT *, '.chuong_' || (k + 1) || CASE WHEN r > 1 THEN '.muc_' || (12 * k + 3) ELSE '' END || CASE r WHEN 5 THEN '.dieu_' || s WHEN 9 THEN '.dieu_' || s || 'a' WHEN 11 THEN '.tieu_muc_' || s ELSE '' END AS tail,
 CASE r WHEN 1 THEN '## Chương ' || (k + 1) WHEN 3 THEN '### Mục ' || s WHEN 11 THEN '### Tiểu mục ' || s ELSE '#### Điều ' || s || CASE WHEN r = 9 THEN 'a' ELSE '' END END AS head,
 ' > Chương ' || (k + 1) || CASE WHEN r > 1 THEN ' > Mục ' || (12 * k + 3) ELSE '' END || CASE r WHEN 5 THEN ' > Điều ' || s WHEN 9 THEN ' > Điều ' || s || 'a' WHEN 11 THEN ' > Tiểu mục ' || s ELSE '' END AS crumbs FROM b),
f AS (SELECT doc_slug || tail AS path, head || chr(10) || chr(10) || body AS v, 'T' || doc_id || crumbs AS crumbs, start_line, end_line, 'SECTION' AS node_type, unit AS statutory_unit, 'C' || doc_id AS doc_code FROM h
 UNION ALL SELECT doc_slug || '.overview', '# T' || doc_id || chr(10) || chr(10) || 'Lời nói đầu', 'T' || doc_id || ' > Overview', 5, 5, 'OVERVIEW', 'DOCUMENT', 'C' || doc_id FROM d WHERE raw_text IS NOT NULL)
SELECT path, rtrim(v) AS verbatim_text, '[' || crumbs || ']' || chr(10) || rtrim(v) AS contextualized_text, start_line, end_line, node_type, statutory_unit, doc_code FROM f"""


@query("chk_profile_legal", LEGAL)
def chk_profile_legal(m: Model) -> DataFrame:
    """The assembled profile of statutes."""
    return ch.chunk_statutes(statute_documents(m)).select("path", "verbatim_text", "contextualized_text", "start_line", "end_line", "node_type", "statutory_unit", "doc_code")


@query("src_inline_docs", f"WITH {D} SELECT doc_slug, title, md5(raw_text) AS h FROM d")
def src_inline_docs(m: Model) -> DataFrame:
    """Documents in memory, given as a table of slug, title, text and suffix."""
    rows = m.docs.select("doc_slug", "title", F.col("raw_text").alias("text"), F.lit(".md").alias("suffix"))
    return corpus.inline_documents(rows)[0].select("doc_slug", "title", F.md5("raw_text").alias("h"))


@query("src_doc_slug", f"WITH {D} SELECT doc_id, 'src1.' || CASE WHEN source = 'src1' THEN '' ELSE source || '.' END || 'doc_' || doc_id AS doc_slug FROM d")
def src_doc_slug(m: Model) -> DataFrame:
    file = F.concat(F.lit("/corpus/"), "source", F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".md"))
    return m.docs.select("doc_id", corpus.slug_of(file, "/corpus", "src1").alias("doc_slug"))


@query("src_dispatch", f"WITH {D} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'nextjs' WHEN doc_id % 4 = 1 THEN 'nodejs' WHEN doc_id % 4 = 2 THEN 'legal' END AS profile FROM d")
def src_dispatch(m: Model) -> DataFrame:
    k = F.col("doc_id") % 4
    file = F.concat(F.when(k == 0, "/x/nextjs/").when(k == 1, "/x/nodejs/").otherwise("/x/other/"), F.col("doc_id").cast("string"), F.lit(".md"))
    text = F.when(k == 2, F.concat(F.lit("# Luật\n## Chương I\n#### Điều 1. "), F.coalesce("raw_text", F.lit("")))).otherwise(F.coalesce("raw_text", F.lit("")))
    return m.docs.select("doc_id", corpus.profile_of(file, text).alias("profile"))


@query("src_relation_types", f"WITH {EDGES} SELECT code, is_symmetric FROM (VALUES {RELATION_ROWS}) r(code, description, is_symmetric) WHERE code IN (SELECT relation_type FROM edges)")
def src_relation_types(m: Model) -> DataFrame:
    """The relation types in use, seeded where they are absent."""
    used = m.edges.select(F.col("relation_type").alias("code")).distinct()
    seeded = corpus.seed(m.relations.where("code < 'E'"), m.relations, "code")
    return seeded.join(used, "code", "left_semi").select("code", "is_symmetric")


@query("src_eval_cases", "SELECT item_id AS id, 'src' || (item_id % 20) || '.doc_' || item_id AS doc_slug, CASE WHEN item_id % 2 = 0 THEN 's_1' ELSE '' END AS path_suffix FROM benchmark")
def src_eval_cases(m: Model) -> DataFrame:
    """Cases written as JSON Lines with expected targets as path strings, and read as slug and suffix."""
    k = F.col("item_id")
    slug = F.concat(F.lit("src"), (k % 20).cast("string"), F.lit(".doc_"), k.cast("string"))
    path = F.when(k % 2 == 0, F.concat(slug, F.lit(".s_1"))).otherwise(slug)
    expected = F.array(F.struct(F.lit(None).cast("string").alias("doc_slug"), path.alias("path"), F.lit(None).cast("string").alias("path_suffix")))
    cases = m.table("benchmark").select(k.cast("string").alias("id"), F.lit("dev").alias("test_set"), F.col("text").alias("query"), F.array(slug, F.lit("src")).alias("doc_slugs"), expected.alias("expected"))
    out = f"{scratch_folder(m.spark, 'cases')}/cases.jsonl"
    corpus.write_cases(cases, out)
    return corpus.read_cases(m.spark, out).select(F.col("id").cast("long").alias("id"), F.explode("expected").alias("e")).select("id", "e.doc_slug", "e.path_suffix")
