"""Queries over sections, footnotes, headings and assembled documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import sections as S
from pagemill.plans.base import LINES_SQL, PAGED_SQL, PAGES_SQL, docs, paged, pages, query
from pagemill.sources import corpus

# Plain documents have no marks: short lines are taken for headings, some others for footnotes, by the same rule in both engines.
MD_SQL = f"""{LINES_SQL}, mdl AS (SELECT doc_id, line_no, line_no // 4 + 1 AS page, CASE WHEN length(line) BETWEEN 1 AND 40 THEN repeat('#', CAST(1 + (doc_id + line_no * 2) % 4 AS INT)) || ' ' || line WHEN (doc_id + line_no) % 5 = 1 THEN (line_no % 3 + 1) || '. ' || line ELSE line || ' [' || (line_no % 3 + 1) || ']' END AS line FROM dlines),
 mdp AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM mdl GROUP BY doc_id, page)"""
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
HEAD_SQL = f"""{LINES_SQL}, hd AS (SELECT doc_id, line_no AS ord, 1 + (doc_id + line_no * 2) % 4 AS level, line AS title, line_no // 4 + 1 AS page FROM dlines WHERE regexp_matches(line, '[^ \\t\\r\\n\\f\\v]'))"""
SHORT = 40  #: characters of a line that is marked up as a heading


def marked_lines(ls, doc):
    def mark(line, i):
        level = (F.lit(1) + (doc + i * 2) % 4).cast("int")
        number = (i % 3 + 1).cast("string")
        return (
            F.when(F.length(line).between(1, SHORT), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), line))
            .when((doc + i) % 5 == 1, F.concat(number, F.lit(". "), line))
            .otherwise(F.concat(line, F.lit(" ["), number, F.lit("]")))
        )

    return F.transform(ls, mark)


def marked(spark, d):
    """(doc_id, n, pages) of the marked-up documents."""
    md = docs(spark, d).where("text IS NOT NULL").select("doc_id", F.array_join(marked_lines(T.lines("text"), F.col("doc_id")), "\n").alias("text"))
    return corpus.paged_documents(md)


def marked_pages(spark, d):
    return marked(spark, d).select("doc_id", F.posexplode("pages").alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("page"), "text")


def headed(spark, d):
    """(doc_id, n, h): a row for each document with its pages' number and its headings, which are all lines that are not blank, in order."""

    def heading(line, i):
        i = i.cast("long")
        return F.struct(i.alias("ord"), (1 + (F.col("doc_id") + i * 2) % 4).alias("level"), line.alias("title"), (F.floor(i / 4) + 1).alias("page"))

    found = F.filter(F.transform(T.lines("text"), heading), lambda x: x["title"].rlike(r"\S"))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", corpus.page_count("text").alias("n"), found.alias("h"))


def headings(spark, d):
    return headed(spark, d).select("doc_id", F.inline("h"))


def levels_of(h):
    return F.transform(h, lambda x: x["level"].cast("int"))


SECTIONS_SQL = MD_SQL + f""", hl AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\\s+(.+)$') AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) = 1 AS f FROM mdl),
 g AS (SELECT *, sum(CASE WHEN h OR f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS n FROM hl),
 sec0 AS (SELECT doc_id, page, n, max(CASE WHEN h THEN length(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1)) ELSE 0 END) AS level, coalesce(max(CASE WHEN h THEN {TRIM.format("regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2)")} END), '') AS title, {TRIM.format("coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY line_no), '')")} AS content FROM g GROUP BY doc_id, page, n),
 sec AS (SELECT doc_id, page, CAST(n AS BIGINT) AS n, CAST(level AS BIGINT) AS level, title, content FROM sec0 QUALIFY content <> '' OR title <> '' OR n < max(n) OVER (PARTITION BY doc_id, page))"""


def sections(spark, d):
    got = marked_pages(spark, d).select("doc_id", "page", F.explode(S.parse("text")).alias("s"))
    return got.select("doc_id", "page", F.col("s.n").cast("long").alias("n"), F.col("s.level").cast("long").alias("level"), "s.title", "s.content")


@query("parse_sections", f"WITH {SECTIONS_SQL} SELECT * FROM sec")
def parse_sections(spark, d):
    return sections(spark, d)


DEFS = "'(?m)^(\\d+)\\.\\s+(.+)$'"
NOTES_SQL = MD_SQL + f""", nt0 AS (SELECT doc_id, page, unnest(regexp_extract_all(text, {DEFS}, 1)) AS id, unnest(regexp_extract_all(text, {DEFS}, 2)) AS content, generate_subscripts(regexp_extract_all(text, {DEFS}, 1), 1) AS seq FROM mdp),
 nt AS (SELECT doc_id, page, id, {TRIM.format('content')} AS content FROM nt0 QUALIFY row_number() OVER (PARTITION BY doc_id, page, id ORDER BY seq) = 1)"""


def notes(spark, d):
    return marked_pages(spark, d).select("doc_id", "page", F.explode(S.footnotes("text")).alias("x")).select("doc_id", "page", "x.id", "x.content")


@query("split_footnotes", f"WITH {NOTES_SQL} SELECT * FROM nt")
def split_footnotes(spark, d):
    return notes(spark, d)


@query("text_without_footnotes", f"WITH {MD_SQL} SELECT doc_id, page, md5({TRIM.format(f"regexp_replace(regexp_replace(text, {DEFS}, '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")}) AS text_md5 FROM mdp")
def text_without_footnotes(spark, d):
    return marked_pages(spark, d).select("doc_id", "page", F.md5(S.without_footnotes("text")).alias("text_md5"))


@query("last_wins_footnotes", f"WITH {NOTES_SQL} SELECT doc_id, id, page, content FROM nt QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY page DESC) = 1")
def last_wins_footnotes(spark, d):
    w = Window.partitionBy("doc_id", "id").orderBy(F.desc("page"))
    return notes(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query("footnote_refs", f"WITH {SECTIONS_SQL}, {NOTES_SQL.split(MD_SQL + ', ')[1]} SELECT s.doc_id, s.page, s.n, f.id FROM sec s JOIN nt f ON s.doc_id = f.doc_id AND s.page = f.page AND contains(s.content, '[' || f.id || ']')")
def footnote_refs(spark, d):
    got = marked_pages(spark, d).select("doc_id", "page", S.footnotes("text").alias("notes"), F.explode(S.parse("text")).alias("s"))
    return got.select("doc_id", "page", F.col("s.n").cast("long").alias("n"), F.explode(S.references(F.col("s.content"), "notes")).alias("id"))


@query(
    "footnote_resolve",
    f"WITH {SECTIONS_SQL}, {NOTES_SQL.split(MD_SQL + ', ')[1]}, lw AS (SELECT doc_id, id, content FROM nt QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY page DESC) = 1) SELECT s.doc_id, s.page, s.n, f.id, '[^' || f.id || ']: ' || l.content AS line FROM sec s JOIN nt f ON s.doc_id = f.doc_id AND s.page = f.page AND contains(s.content, '[' || f.id || ']') JOIN lw l ON l.doc_id = f.doc_id AND l.id = f.id",
)
def footnote_resolve(spark, d):
    known = last_wins_footnotes(spark, d).select("doc_id", "id", "content")
    return footnote_refs(spark, d).join(known, ["doc_id", "id"]).select("doc_id", "page", "n", "id", F.format_string("[^%s]: %s", "id", "content").alias("line"))


@query(
    "footnote_first_use",
    f"WITH {SECTIONS_SQL}, {NOTES_SQL.split(MD_SQL + ', ')[1]} SELECT s.doc_id, f.id, s.page, s.n FROM sec s JOIN nt f ON s.doc_id = f.doc_id AND s.page = f.page AND contains(s.content, '[' || f.id || ']') QUALIFY row_number() OVER (PARTITION BY s.doc_id, f.id ORDER BY s.page, s.n) = 1",
)
def footnote_first_use(spark, d):
    first = footnote_refs(spark, d).groupBy("doc_id", "id").agg(F.min(F.struct("page", "n")).alias("m"))
    return first.select("doc_id", "id", "m.page", "m.n")


@query("normalize_footnotes", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('See [' || doc_id % 10 || '] and (' || doc_id % 7 || ') or ^' || doc_id % 9 || ' .', '\\[(\\d+)\\]', '[^\\1]', 'g'), '\\((\\d+)\\)', '[^\\1]', 'g'), '\\^(\\d+) ', '[^\\1] ', 'g') AS text FROM documents")
def normalize_footnotes(spark, d):
    part = lambda m: (F.col("doc_id") % m).cast("string")
    raw = F.concat(F.lit("See ["), part(10), F.lit("] and ("), part(7), F.lit(") or ^"), part(9), F.lit(" ."))
    return docs(spark, d).select("doc_id", T.footnote_markers(raw).alias("text"))


STRIP_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*The\\.\\s*$', '', 'g'), '(?m)^\\s*\\d+\\s*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query("strip_repeated", f"SELECT doc_id, md5({TRIM.format(STRIP_SQL)}) AS text_md5 FROM documents WHERE text IS NOT NULL")
def strip_repeated(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(S.strip_repeated("text", ["The."], r"^\s*\d+\s*$")).alias("text_md5"))


def clean_sql(x):
    x = f"regexp_replace({x}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
    x = f"{TRIM.format(f"regexp_replace({x}, '(?m)[ \\t]+$', '', 'g')")} || chr(10)"
    x = f"regexp_replace(regexp_replace({x}, '(?m)^[-*+]\\s*$', '', 'g'), '(?m)^#{{1,6}}\\s*$', '', 'g')"
    for k in range(6, 0, -1):
        x = f"regexp_replace({x}, '(?m)^({'#' * k})\\s+{'#' * k}\\s+', '\\1 ', 'g')"
    return f"regexp_replace({x}, '(?m)^[-*_]{{3,}}$', '---', 'g')"


DIRTY_SQL = "text || repeat(chr(10), CAST(doc_id % 6 AS INT)) || '## ' || chr(10) || '- ' || chr(10) || '## ## Title  ' || chr(10) || '*****' || chr(10) || 'end   '"


@query("cleanup_markdown", f"SELECT doc_id, md5({clean_sql('(' + DIRTY_SQL + ')')}) AS text_md5 FROM documents WHERE text IS NOT NULL")
def cleanup_markdown(spark, d):
    dirty = F.concat(F.col("text"), F.repeat(F.lit("\n"), (F.col("doc_id") % 6).cast("int")), F.lit("## \n- \n## ## Title  \n*****\nend   "))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(T.cleaned_markdown(dirty)).alias("text_md5"))


@query("hierarchy_errors", f"WITH {HEAD_SQL} SELECT doc_id, ord, level, prev FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM hd) WHERE prev > 0 AND level > prev + 1")
def hierarchy_errors(spark, d):
    with_prev = T.let(F.col("h"), lambda h: F.transform(h, lambda x, k: F.struct(x["ord"].alias("ord"), x["level"].alias("level"), F.get(h, k - 1)["level"].alias("prev"))))
    return headed(spark, d).select("doc_id", F.inline(with_prev)).where("prev > 0 AND level > prev + 1")


FIX_SQL = "list_reduce(list_prepend([0, 0], list_transform(list(level ORDER BY ord), lambda v: [v, v])), lambda a, b: CASE WHEN b[1] = 0 THEN list_append(a, 0) WHEN a[1] = 0 THEN list_concat([CASE WHEN b[1] > 2 THEN 1 ELSE b[1] END], a[2:], [CASE WHEN b[1] > 2 THEN 1 ELSE b[1] END]) ELSE list_concat([least(b[1], a[1] + 1)], a[2:], [least(b[1], a[1] + 1)]) END)[3:]"


@query("hierarchy_fix", f"WITH {HEAD_SQL} SELECT doc_id, array_to_string(list(level ORDER BY ord), ',') AS levels, array_to_string({FIX_SQL}, ',') AS fixed FROM hd GROUP BY doc_id")
def hierarchy_fix(spark, d):
    got = headed(spark, d).where(F.size("h") > 0).select("doc_id", levels_of("h").alias("levels"))
    return got.select("doc_id", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), F.array_join(S.repaired_levels(F.col("levels")).cast("array<string>"), ",").alias("fixed"))


@query("previous_chapter", f"WITH {HEAD_SQL} SELECT doc_id, ord, level, last_value(CASE WHEN level = 1 THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chapter, last_value(CASE WHEN level = 1 THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM hd")
def previous_chapter(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ord")
    chapter = F.last(F.when(F.col("level") == 1, F.col("ord")), True)
    return headings(spark, d).select("doc_id", "ord", "level", chapter.over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("chapter"), chapter.over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("current"))


KIND_SQL = "['academic', 'book', 'report', 'manual', 'article', 'legal', 'other'][doc_id % 7 + 1]"


@query("footnote_placement", f"SELECT doc_id, kind, CASE WHEN kind = 'academic' THEN 'document-end' WHEN kind IN ('book', 'report', 'manual') THEN 'section-end' ELSE 'inline' END AS placement FROM (SELECT doc_id, {KIND_SQL} AS kind FROM documents)")
def footnote_placement(spark, d):
    kinds = F.array(*map(F.lit, ("academic", "book", "report", "manual", "article", "legal", "other")))
    return docs(spark, d).select("doc_id", F.get(kinds, (F.col("doc_id") % 7).cast("int")).alias("kind")).withColumn("placement", S.placement("kind"))


CHAIN_SQL = HEAD_SQL + """, ch AS (SELECT doc_id, ord, row_number() OVER w AS k, level, title, CASE WHEN ord % 4 = 1 THEN 'x' WHEN ord % 2 = 0 THEN CAST(lag(ord) OVER w AS VARCHAR) END AS parent FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 wk AS (WITH RECURSIVE t AS (SELECT doc_id, ord AS root, ord, k, [k] AS path FROM ch c WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM ch p WHERE p.doc_id = c.doc_id AND CAST(p.ord AS VARCHAR) = c.parent) UNION ALL SELECT c.doc_id, t.root, c.ord, c.k, list_append(t.path, c.k) FROM t JOIN ch c ON c.doc_id = t.doc_id AND c.parent = CAST(t.ord AS VARCHAR)) SELECT * FROM t)"""


@query("merge_continuations", f"WITH {CHAIN_SQL} SELECT w.doc_id, CAST(w.root AS VARCHAR) AS id, string_agg(c.title, chr(10) || chr(10) ORDER BY w.path) AS content, CAST(count(*) AS BIGINT) AS parts FROM wk w JOIN ch c ON c.doc_id = w.doc_id AND c.ord = w.ord GROUP BY w.doc_id, w.root")
def merge_continuations(spark, d):
    def section(h, x, k):
        parent = F.when(x["ord"] % 4 == 1, F.lit("x")).when(x["ord"] % 2 == 0, F.get(h, k - 1)["ord"].cast("string"))
        return F.struct(x["ord"].cast("string").alias("id"), x["level"].cast("int").alias("level"), x["title"].alias("title"), x["title"].alias("content"), parent.alias("continues_from"))

    per = headed(spark, d).select("doc_id", T.let(F.col("h"), lambda h: F.transform(h, lambda x, k: section(h, x, k))).alias("s"))
    return per.select("doc_id", F.explode(S.merged(F.col("s"))).alias("m")).select("doc_id", "m.id", "m.content", F.col("m.parts").cast("long").alias("parts"))


@query("anchor_slugs", f"WITH {HEAD_SQL} SELECT doc_id, ord, regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g') AS slug FROM hd")
def anchor_slugs(spark, d):
    return headings(spark, d).select("doc_id", "ord", T.slug("title").alias("slug"))


@query("toc_render", f"WITH {HEAD_SQL} SELECT doc_id, '## Table of Contents' || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN level <= 3 THEN repeat('  ', CAST(level - 1 AS INT)) || '- [' || title || '](#' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g') || ')' END, chr(10) ORDER BY ord), '') || chr(10) AS toc FROM hd GROUP BY doc_id")
def toc_render(spark, d):
    entries = F.transform("h", lambda x: F.struct(x["level"].cast("int").alias("level"), x["title"].alias("title"), (x["level"] - 1).cast("int").alias("depth")))
    return headed(spark, d).where(F.size("h") > 0).select("doc_id", S.toc(entries).alias("toc"))


RENDER_SQL = "CASE WHEN title <> '' AND level > 0 THEN repeat('#', CAST(level AS INT)) || ' ' || title || chr(10) || CASE WHEN {c} <> '' THEN chr(10) ELSE '' END ELSE '' END || {c}"


def marked_sql(x):
    """The three rules for footnote marks without look-aheads: what must stay is put aside under other characters, and put back."""
    for left, right, barred in (("\\[", "\\]", "\\("), ("\\(", "\\)", "\\[")):
        plain = [c.strip("\\") for c in (left, right, barred)]
        x = f"regexp_replace({x}, '{left}(\\d+){right}{barred}', chr(2) || '\\1' || chr(3), 'g')"
        x = f"regexp_replace({x}, '{left}(\\d+){right}', '[^\\1]', 'g')"
        x = f"regexp_replace({x}, chr(2) || '(\\d+)' || chr(3), '{plain[0]}\\1{plain[1]}{plain[2]}', 'g')"
    x = f"regexp_replace({x}, '\\^(\\d)\\]', chr(2) || '\\1]', 'g')"
    x = f"regexp_replace({x}, '\\^(\\d+)(\\d)\\]', '[' || chr(3) || '\\1]\\2]', 'g')"
    return f"replace(replace(regexp_replace({x}, '\\^(\\d+)', '[' || chr(3) || '\\1]', 'g'), chr(2), '^'), chr(3), '^')"


@query("render_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, page, n, md5({RENDER_SQL.format(c='c')}) AS markdown_md5 FROM (SELECT *, {marked_sql('content')} AS c FROM sec)")
def render_sections(spark, d):
    return sections(spark, d).select("doc_id", "page", "n", F.md5(S.rendered(F.col("level").cast("int"), "title", "content")).alias("markdown_md5"))


@query("assemble_pages", f"WITH {PAGED_SQL} SELECT doc_id, n, md5(array_to_string(pages, chr(10) || chr(10))) AS markdown_md5 FROM paged")
def assemble_pages(spark, d):
    return paged(spark, d).select("doc_id", "n", F.md5(F.array_join("pages", "\n\n")).alias("markdown_md5"))


@query("headings_by_level", f"WITH {HEAD_SQL} SELECT doc_id, {', '.join(f'CAST(count(*) FILTER (level = {k}) AS BIGINT) AS h{k}' for k in range(1, 7))}, greatest(1, max(level)) AS max_depth FROM hd GROUP BY doc_id")
def headings_by_level(spark, d):
    got = headed(spark, d).where(F.size("h") > 0).select("doc_id", levels_of("h").alias("l"))
    count = lambda k: F.size(F.filter("l", lambda x: x == k)).cast("long").alias(f"h{k}")
    return got.select("doc_id", *map(count, range(1, 7)), F.greatest(F.lit(1), F.array_max("l")).cast("long").alias("max_depth"))


@query("headings_by_page", f"WITH {HEAD_SQL} SELECT doc_id, page, string_agg(title, '|' ORDER BY ord) AS titles FROM hd GROUP BY ALL")
def headings_by_page(spark, d):
    got = headings(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("h"))
    return got.select("doc_id", "page", F.array_join(F.transform("h", lambda x: x["title"]), "|").alias("titles"))


def in_force(spark, d, most: int | None = None):
    """For each page, the last heading (in order) that begins on it or before: a running maximum, not a range join."""
    h = headings(spark, d)
    h = h.where(F.col("level") <= most) if most else h
    events = h.select("doc_id", "page", F.lit(0).alias("kind"), F.struct("ord", "level", "title").alias("h")).unionAll(pages(spark, d).select("doc_id", "page", F.lit(1).alias("kind"), F.lit(None).cast("struct<ord:bigint,level:bigint,title:string>").alias("h")))
    w = Window.partitionBy("doc_id").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("doc_id", "page", "kind", F.max("h").over(w).alias("h")).where("kind = 1")


@query("asof_toc_entry", f"WITH {PAGES_SQL}, {HEAD_SQL} SELECT p.doc_id, p.page, arg_max(h.title, h.ord) AS title, max(h.ord) AS ord FROM dpages p LEFT JOIN hd h ON h.doc_id = p.doc_id AND h.page <= p.page GROUP BY p.doc_id, p.page")
def asof_toc_entry(spark, d):
    return in_force(spark, d).select("doc_id", "page", "h.title", "h.ord")


@query("asof_section", f"WITH {PAGES_SQL}, {HEAD_SQL} SELECT p.doc_id, p.page, arg_max(h.title, h.ord) AS title, max(h.ord) AS ord FROM dpages p LEFT JOIN (SELECT * FROM hd WHERE level <= 2) h ON h.doc_id = p.doc_id AND h.page <= p.page GROUP BY p.doc_id, p.page")
def asof_section(spark, d):
    return in_force(spark, d, 2).select("doc_id", "page", "h.title", "h.ord")


@query("expected_headings", f"WITH {PAGES_SQL}, {HEAD_SQL} SELECT p.doc_id, p.page, coalesce(string_agg(h.level || ':' || h.title, '|' ORDER BY h.ord), '') AS expected FROM dpages p LEFT JOIN hd h ON h.doc_id = p.doc_id AND h.page = p.page GROUP BY p.doc_id, p.page")
def expected_headings(spark, d):
    per = headings(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "level", "title").alias("t")))).alias("h"))
    joined = pages(spark, d).select("doc_id", "page").join(per, ["doc_id", "page"], "left")
    return joined.select("doc_id", "page", F.coalesce(F.array_join(F.transform("h", lambda x: x["t"]), "|"), F.lit("")).alias("expected"))


@query(
    "section_tree",
    f"WITH {HEAD_SQL}, tot AS (SELECT doc_id, max(line_no // 4 + 1) AS n FROM dlines GROUP BY doc_id) SELECT h.doc_id, h.ord, h.level, h.page AS start_page, coalesce(lead(h.page) OVER (PARTITION BY h.doc_id ORDER BY h.ord) - 1, n) AS end_page, (SELECT max(p.ord) FROM hd p WHERE p.doc_id = h.doc_id AND p.ord < h.ord AND p.level < h.level) AS parent FROM hd h JOIN tot USING (doc_id)",
)
def section_tree(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # The parent is the last earlier heading of a smaller level: of the last ones of each level, the latest.
    parent = F.greatest(*(F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("ord"))).over(before)) for k in range(1, 6)))
    h = headed(spark, d).select("doc_id", "n", F.inline("h")).withColumn("parent", parent).withColumn("follows", F.lead("page").over(w) - 1)
    return h.select("doc_id", "ord", "level", F.col("page").alias("start_page"), F.coalesce("follows", "n").alias("end_page"), "parent")


@query("merge_pages_light", f"WITH {PAGED_SQL}, m AS (SELECT doc_id, i, n, pages[i] AS t, coalesce(pages[i + 1], '') AS nx FROM (SELECT doc_id, n, pages, unnest(range(1, n + 1)) AS i FROM paged)) SELECT doc_id, md5(string_agg(CASE WHEN i < n AND NOT regexp_matches(regexp_replace(t, '\\s+$', ''), '[.!?:;''\"]$') AND (regexp_matches(regexp_replace(nx, '^\\s+', ''), '^[a-z]') OR NOT starts_with(regexp_replace(nx, '^\\s+', ''), '#')) THEN regexp_replace(t, '\\s+$', '') || ' ' ELSE {TRIM.format('t')} END, chr(10) || chr(10) ORDER BY i)) AS markdown_md5 FROM m GROUP BY doc_id")
def merge_pages_light(spark, d):
    return paged(spark, d).select("doc_id", F.md5(S.merged_pages("pages")).alias("markdown_md5"))


@query("continuation_links", f"WITH {PAGES_SQL}, l AS (SELECT doc_id, page, {TRIM.format('text')} AS c, {TRIM.format('lag(text) OVER (PARTITION BY doc_id ORDER BY page)')} AS p FROM dpages) SELECT doc_id, page, coalesce(p <> '' AND c <> '' AND NOT regexp_matches(p, '[.!?:;''\"]$') AND (regexp_matches(c, '^[a-z]') OR NOT starts_with(c, '#')), FALSE) AS continues FROM l")
def continuation_links(spark, d):
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages(spark, d).select("doc_id", "page", T.continues(F.lag("text").over(w), F.col("text")).alias("continues"))
