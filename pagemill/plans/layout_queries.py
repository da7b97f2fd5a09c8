"""Queries over layout, windows, geometry, validation, answers and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import geometry, layout, structure, validation, windows
from pagemill.plans.base import LINES_SQL, PAGED_SQL, PAGES_SQL, docs, paged, pages, query
from pagemill.plans.content_queries import HEAD_SQL, TRIM, headed, headings, levels_of
from pagemill.sources import corpus

# Page layouts are derived from ids by the same arithmetic in both engines.
LAYOUT_SQL = f"""{PAGES_SQL}, pl AS (SELECT doc_id, page, 0.0::DOUBLE AS header_top, ((doc_id * 7 + page * 3) % 12)::DOUBLE AS header_bottom, (85 + (doc_id + page) % 10)::DOUBLE AS footer_top, 100.0::DOUBLE AS footer_bottom, ((doc_id + page * 2) % 8)::DOUBLE AS margin_left, (92 + page % 5)::DOUBLE AS margin_right,
 ['none', 'numbered', 'symbolic'][CAST((doc_id + page * page) % 3 AS INT) + 1] AS footnote_style, CASE WHEN doc_id % 3 = 0 AND page % 2 = 0 THEN 'double' ELSE 'single' END AS column_layout FROM dpages)"""
ZONES = ", ".join(layout.ZONES)


def page_layouts(spark, d):
    i, p = F.col("doc_id"), F.col("page")
    num = lambda x: x.cast("double")
    styles = F.array(F.lit("none"), F.lit("numbered"), F.lit("symbolic"))
    return pages(spark, d).select(
        "doc_id", "page", F.lit(0.0).alias("header_top"), num((i * 7 + p * 3) % 12).alias("header_bottom"), num(85 + (i + p) % 10).alias("footer_top"), F.lit(100.0).alias("footer_bottom"),
        num((i + p * 2) % 8).alias("margin_left"), num(92 + p % 5).alias("margin_right"), F.get(styles, ((i + p * p) % 3).cast("int")).alias("footnote_style"),
        F.when((i % 3 == 0) & (p % 2 == 0), "double").otherwise("single").alias("column_layout"),
    )


@query("zone_medians", f"WITH {LAYOUT_SQL} SELECT doc_id, {', '.join(f'median({z}) AS {z}' for z in layout.ZONES)} FROM pl GROUP BY doc_id")
def zone_medians(spark, d):
    return layout.zone_medians(page_layouts(spark, d))


STYLE_SQL = "SELECT doc_id, footnote_style FROM (SELECT doc_id, footnote_style, count(*) AS n, min(page) AS f FROM pl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1"


@query("footnote_style_mode", f"WITH {LAYOUT_SQL} {STYLE_SQL}")
def footnote_style_mode(spark, d):
    return layout.most_common(page_layouts(spark, d), "footnote_style", "page")


COLUMNS_SQL = "SELECT doc_id, CASE WHEN count(DISTINCT column_layout) = 1 THEN min(column_layout) ELSE 'mixed' END AS column_layout FROM pl GROUP BY doc_id"


@query("column_consensus", f"WITH {LAYOUT_SQL} {COLUMNS_SQL}")
def column_consensus(spark, d):
    return layout.consensus(page_layouts(spark, d), "column_layout")


@query("layout_profile", f"WITH {LAYOUT_SQL} SELECT * FROM (SELECT doc_id, {', '.join(f'median({z}) AS {z}' for z in layout.ZONES)} FROM pl GROUP BY doc_id) JOIN ({STYLE_SQL}) USING (doc_id) JOIN ({COLUMNS_SQL}) USING (doc_id)")
def layout_profile(spark, d):
    return layout.profiles(page_layouts(spark, d))


NORM_SQL = TRIM.format("regexp_replace(regexp_replace(lower(line), '\\d+', 'N', 'g'), '\\s+', ' ', 'g')")


@query(
    "repeated_patterns",
    f"WITH {LINES_SQL}, nl AS (SELECT doc_id, line_no, line, {NORM_SQL} AS norm FROM dlines), c AS (SELECT doc_id, norm, count(*) AS n, arg_min(line, line_no) AS line, min(line_no) AS pos FROM nl GROUP BY ALL) SELECT doc_id, norm, line, pos, CAST(n AS BIGINT) AS n FROM c QUALIFY n >= greatest(1, floor(sum(n) OVER (PARTITION BY doc_id) * 0.4::DOUBLE))",
)
def repeated_patterns(spark, d):
    return layout.repeated_lines(corpus.exploded_lines(docs(spark, d)).withColumnRenamed("line_no", "pos"))


EDGE_SQL = f"[x FOR x IN [{TRIM.format('y')} FOR y IN string_split(p, chr(10))] IF x <> '']"


@query(
    "first_last_line_pattern",
    f"""WITH {PAGED_SQL}, e AS (SELECT doc_id, [x[1] FOR x IN l IF len(x) >= 1] AS f, [x[-1] FOR x IN l IF len(x) >= 2] AS z FROM (SELECT doc_id, [{EDGE_SQL} FOR p IN pages] AS l FROM paged))
 SELECT doc_id, CASE WHEN len(f) >= 3 THEN coalesce([x FOR x IN f IF len([y FOR y IN f IF y = x]) >= len(f) * 0.5 AND length(x) > 2][1], CASE WHEN len([x FOR x IN f IF NOT regexp_matches(x, '^\\d+$')]) = 0 THEN '\\d+' END) END AS header,
 CASE WHEN len(z) >= 3 THEN coalesce([x FOR x IN z IF len([y FOR y IN z IF y = x]) >= len(z) * 0.5 AND length(x) > 2][1], CASE WHEN len([x FOR x IN z IF NOT regexp_matches(x, '^\\d+$')]) = 0 THEN '\\d+' END) END AS footer FROM e""",
)
def first_last_line_pattern(spark, d):
    edges = F.transform("pages", layout.edge_lines)
    some = lambda which: F.filter(F.transform("edges", lambda e: e[which]), lambda x: x.isNotNull())
    got = paged(spark, d).withColumn("edges", edges).withColumn("f", some("first")).withColumn("z", some("last"))
    return got.select("doc_id", layout.common_line(F.col("f")).alias("header"), layout.common_line(F.col("z")).alias("footer"))


NUMBERS = "[['- 3 -', '- 4 -'], ['Page 1 of 9'], ['page 12'], ['7', '8'], []]"


@query("page_number_pattern", f"SELECT doc_id, CASE WHEN len(p) = 0 THEN '^\\s*(?:Page\\s+)?\\d+(?:\\s+of\\s+\\d+)?\\s*$' WHEN regexp_matches(array_to_string(p, ' | '), '-\\s*\\d+\\s*-') THEN '^\\s*-\\s*\\d+\\s*-\\s*$' WHEN regexp_matches(array_to_string(p, ' | '), '(?i)page') AND regexp_matches(array_to_string(p, ' | '), '(?i)of') THEN '^\\s*Page\\s+\\d+\\s+of\\s+\\d+\\s*$' WHEN regexp_matches(array_to_string(p, ' | '), '(?i)page') THEN '^\\s*Page\\s+\\d+\\s*$' ELSE '^\\s*\\d+\\s*$' END AS pattern FROM (SELECT doc_id, {NUMBERS}[doc_id % 5 + 1] AS p FROM documents)")
def page_number_pattern(spark, d):
    lists = F.expr("array(array('- 3 -', '- 4 -'), array('Page 1 of 9'), array('page 12'), array('7', '8'), cast(array() as array<string>))")
    return docs(spark, d).withColumn("p", F.get(lists, (F.col("doc_id") % 5).cast("int"))).select("doc_id", layout.page_number_pattern("p").alias("pattern"))


IMAGE_SQL = f"""{PAGES_SQL}, im AS (SELECT doc_id, page, ['Company Logo', 'Bar chart', 'Line ornament'][CAST((doc_id + page) % 3 AS INT) + 1] AS description, ['photo', 'icon', 'chart', 'photo'][CAST((doc_id * 3 + page) % 4 AS INT) + 1] AS kind, ((doc_id * 37 + page * 11) % 1000)::DOUBLE AS x, ((doc_id * 53 + page * 29) % 1000)::DOUBLE AS y, ['header', 'footer', 'margin'][CAST((doc_id + page * 2) % 3 AS INT) + 1] AS zone FROM dpages)"""


def page_images(spark, d):
    i, p = F.col("doc_id"), F.col("page")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    return pages(spark, d).select(
        "doc_id", "page", pick(("Company Logo", "Bar chart", "Line ornament"), i + p).alias("description"), pick(("photo", "icon", "chart", "photo"), i * 3 + p).alias("kind"),
        ((i * 37 + p * 11) % 1000).cast("double").alias("x"), ((i * 53 + p * 29) % 1000).cast("double").alias("y"), pick(("header", "footer", "margin"), i + p * 2).alias("zone"),
    )


@query("decorative_images", f"WITH {IMAGE_SQL} SELECT doc_id, page, contains(lower(description), 'ornament') OR (page <= 2 AND ((zone = 'header' AND y / 10 < 10) OR (zone = 'footer' AND y / 10 > 90) OR (zone = 'margin' AND (x / 10 < 5 OR x / 10 > 95)))) OR kind IN ('logo', 'icon') AS decorative FROM im")
def decorative_images(spark, d):
    zones = {n: F.lit(layout.DEFAULTS[n]) for n in layout.ZONES}
    positions = F.when(F.col("page") <= 2, F.array(F.struct(F.col("page").alias("page"), F.col("zone").alias("zone")))).otherwise(F.array().cast("array<struct<page:bigint,zone:string>>"))
    hit = layout.decorative(F.col("description"), F.col("kind"), F.col("x"), F.col("y"), F.col("page"), F.array(F.lit("Ornament")), positions, zones)
    return page_images(spark, d).select("doc_id", "page", hit.alias("decorative"))


@query("decorative_patterns", f"WITH {IMAGE_SQL} SELECT doc_id, description || ' ' || zone AS pattern, CAST(count(*) AS BIGINT) AS n FROM im JOIN (SELECT doc_id, count(*) AS pages FROM dpages GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, pattern, pages HAVING count(*) >= greatest(1, floor(pages * 0.4::DOUBLE))")
def decorative_patterns(spark, d):
    per = page_images(spark, d).groupBy("doc_id", F.concat_ws(" ", "description", "zone").alias("pattern")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return per.join(paged(spark, d).select("doc_id", F.col("n").alias("pages")), "doc_id").where("n >= greatest(1, floor(pages * 0.4D))").select("doc_id", "pattern", "n")


ANSWER = """'```json {{"headerZone": {{"top": -5, "bottom": ' || doc_id % 130 || '}}, "marginZones": {{"left": ' || doc_id % 70 || ', "right": ' || doc_id % 99 || '}}, "footnoteStyle": "' || {s} || '", "columnLayout": "' || {c} || '"}} ```'"""


@query("coerce_layout_json", f"""SELECT doc_id, greatest(0, least(100, -5.0))::DOUBLE AS header_top, least(100, doc_id % 130)::DOUBLE AS header_bottom, 90.0::DOUBLE AS footer_top, 100.0::DOUBLE AS footer_bottom, least(50, doc_id % 70)::DOUBLE AS margin_left, greatest(50, doc_id % 99)::DOUBLE AS margin_right,
 ['none', 'numbered', 'none'][doc_id % 3 + 1] AS footnote_style, ['single', 'double', 'single', 'mixed'][doc_id % 4 + 1] AS column_layout FROM documents""")
def coerce_layout_json(spark, d):
    i = F.col("doc_id")
    text = F.concat(
        F.lit('```json {"headerZone": {"top": -5, "bottom": '), (i % 130).cast("string"), F.lit('}, "marginZones": {"left": '), (i % 70).cast("string"), F.lit(', "right": '), (i % 99).cast("string"),
        F.lit('}, "footnoteStyle": "'), F.get(F.array(F.lit("odd"), F.lit("numbered"), F.lit("none")), (i % 3).cast("int")),
        F.lit('", "columnLayout": "'), F.get(F.array(F.lit("single"), F.lit("double"), F.lit("odd"), F.lit("mixed")), (i % 4).cast("int")), F.lit('"} ```'),
    )
    return docs(spark, d).withColumn("answer", text).select("doc_id", *layout.coerced("answer"))


@query(
    "validate_structure_json",
    "SELECT doc_id, ['book', 'other', 'manual'][doc_id % 3 + 1] AS document_type, least(6, greatest(1, doc_id % 9)) || ':' || least(20, greatest(1, doc_id % 30)) || ':T|1:1:Untitled' AS toc, least(6, greatest(1, doc_id % 8)) AS max_depth, CASE WHEN 20 - doc_id % 9 < 1 + least(20, greatest(1, doc_id % 4)) THEN 1 ELSE 1 + least(20, greatest(1, doc_id % 4)) END AS body_start, CAST(20 - doc_id % 9 AS BIGINT) AS body_end, CASE WHEN doc_id % 2 = 0 THEN 'endnote' ELSE 'inline' END AS footnote_style, CAST(NULL AS VARCHAR) AS citation_style FROM documents",
)
def validate_structure_json(spark, d):
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    text = F.concat(
        F.lit('Here: {"documentType": "'), F.get(F.array(F.lit("book"), F.lit("novel"), F.lit("manual")), (i % 3).cast("int")), F.lit('", "toc": {"explicit": true, "entries": [{"level": '), s(i % 9), F.lit(', "title": "T", "page": '), s(i % 30),
        F.lit('}, {}]}, "hierarchy": {"maxDepth": '), s(i % 8), F.lit('}, "sections": {"frontMatter": {"start": 1, "end": '), s(i % 4), F.lit('}, "body": {"end": '), s(20 - i % 9), F.lit('}}, "crossReferences": {"footnoteStyle": "'),
        F.when(i % 2 == 0, "endnote").otherwise("odd"), F.lit('", "citationStyle": ""}} done'),
    )
    return docs(spark, d).withColumn("answer", text).select("doc_id", *structure.validated("answer", F.lit(20)))


@query("parse_response", f"SELECT doc_id, {TRIM.format('text')} AS content, 's' || doc_id AS summary, 'end ' || doc_id AS last_paragraph, 'img_placeholder_1:d' || doc_id || ':0.0,0.0,1000.0,1000.0:other' AS images FROM documents WHERE text IS NOT NULL")
def parse_response(spark, d):
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("intro [Content] "), F.col("text"), F.lit(' [IMAGES] ```json {"img_placeholder_1": {"description": "d'), i, F.lit('"}} ``` [SUMMARY] s'), i, F.lit(" [LAST_PARAGRAPH] end "), i, F.lit(" "))
    got = docs(spark, d).where("text IS NOT NULL").withColumn("raw", raw)
    entries = F.transform(F.map_entries(structure.parsed_images("raw")), lambda e: F.concat_ws(":", e["key"], e["value"]["description"], F.array_join(e["value"]["bbox"].cast("array<string>"), ","), e["value"]["type"]))
    return got.select("doc_id", *structure.parsed_response("raw"), F.array_join(entries, "|").alias("images"))


@query("placeholder_substitute", "SELECT doc_id, 'a ![x](data:1)' || chr(10) || 'b ![y](data:10)' || chr(10) || '> *[Image: z]*' || chr(10) || '> *[Image: w]* ' || doc_id AS text FROM documents")
def placeholder_substitute(spark, d):
    text = F.concat(F.lit("a ![x](img_placeholder_1)\nb ![y](img_placeholder_10)\n![z](img_placeholder_7)\n![w]( ) "), F.col("doc_id").cast("string"))
    crops = F.create_map(F.lit("img_placeholder_1"), F.lit("data:1"))  # as is compatible, it also fills the begin of img_placeholder_10
    return docs(spark, d).select("doc_id", structure.placeholders_filled(text, crops).alias("text"))


@query("image_resolve", "SELECT doc_id, 'p ![Chart](u1) q  r ![Image b](u2)  end' || doc_id AS text FROM documents")
def image_resolve(spark, d):
    text = F.concat(F.lit("p {{image:a}} q [image:deco] r {{image:b}} [image:none] end"), F.col("doc_id").cast("string"))
    images = F.expr("map('a', named_struct('description', 'Chart', 'url', 'u1', 'decorative', false), 'b', named_struct('description', '', 'url', 'u2', 'decorative', false), 'deco', named_struct('description', 'x', 'url', 'u3', 'decorative', true))")
    got = docs(spark, d).select("doc_id", text.alias("t"), images.alias("images"))
    return got.select("doc_id", structure.images_resolved("t", "images").alias("text"))


MESSAGES = ("Rate limit reached", "got 429", "Request TIMEOUT", "status: 503 bad", "status 404", "ECONNRESET by peer", "network down", "odd")
MESSAGE_SQL = "[" + ", ".join(f"'{m}'" for m in MESSAGES) + "][doc_id % 8 + 1]"


@query("error_classification", f"SELECT doc_id, message, ['rate_limit', 'rate_limit', 'timeout', 'api', 'api', 'api', 'api', 'api'][doc_id % 8 + 1] AS kind, CAST([NULL, NULL, NULL, 503, 404, NULL, NULL, NULL][doc_id % 8 + 1] AS BIGINT) AS status, [TRUE, TRUE, TRUE, TRUE, FALSE, TRUE, TRUE, FALSE][doc_id % 8 + 1] AS retryable FROM (SELECT doc_id, {MESSAGE_SQL} AS message FROM documents)")
def error_classification(spark, d):
    got = docs(spark, d).select("doc_id", F.get(F.array(*map(F.lit, MESSAGES)), (F.col("doc_id") % 8).cast("int")).alias("message"))
    return got.select("doc_id", "message", *structure.error_class("message"))


URLS = ("data:image/png;base64,AAAA", "https://x.org/a", "./a.png", "/a", "photo.JPG", "ftp://x", "")


@query("image_url_validity", "SELECT doc_id, url, CASE WHEN starts_with(url, 'data:image/') THEN length(url) > 50 WHEN regexp_matches(url, '^https?://') THEN TRUE WHEN starts_with(url, './') OR starts_with(url, '/') THEN TRUE ELSE regexp_matches(url, '(?i)^[\\w-]+\\.(png|jpg|jpeg|gif|webp|svg)$') END AS valid FROM (SELECT doc_id, [" + ", ".join(f"'{u}'" for u in URLS) + "][doc_id % 7 + 1] || CASE WHEN doc_id % 7 = 0 THEN repeat('B', CAST(doc_id % 50 AS INT)) ELSE '' END AS url FROM documents)")
def image_url_validity(spark, d):
    i = F.col("doc_id")
    url = F.concat(F.get(F.array(*map(F.lit, URLS)), (i % 7).cast("int")), F.when(i % 7 == 0, F.repeat(F.lit("B"), (i % 50).cast("int"))).otherwise(""))
    return docs(spark, d).select("doc_id", url.alias("url")).withColumn("valid", validation.image_url_ok("url"))


def cost_sql(p):
    (a, b, x), (c, e, y) = structure.PRICES[p]
    return f"round((n * ({a} + k * {b})) / 1000000.0::DOUBLE * {x}::DOUBLE + (n * ({c} + k * {e})) / 1000000.0::DOUBLE * {y}::DOUBLE, 9)"


@query("cost_estimate", f"WITH {PAGED_SQL} SELECT doc_id, {cost_sql('vision')} AS vision, {cost_sql('flash')} AS flash FROM (SELECT doc_id, n, (doc_id % 10) / 10.0::DOUBLE AS k FROM paged)")
def cost_estimate(spark, d):
    got = paged(spark, d).withColumn("k", (F.col("doc_id") % 10) / F.lit(10.0))
    return got.select("doc_id", *(F.round(structure.cost("n", "k", p), 9).alias(p) for p in ("vision", "flash")))


@query("provider_route", "SELECT doc_id, CASE WHEN NOT v AND NOT f THEN NULL WHEN v AND NOT f THEN 'vision' WHEN NOT v THEN 'flash' WHEN c THEN 'vision' WHEN p AND n <= 100 THEN 'vision' WHEN n > 100 THEN 'flash' ELSE 'vision' END AS provider FROM (SELECT doc_id, doc_id % 2 = 0 AS v, doc_id % 3 <> 0 AS f, doc_id % 5 = 0 AS c, doc_id % 7 = 0 AS p, doc_id % 200 AS n FROM documents)")
def provider_route(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", structure.route(i % 2 == 0, i % 3 != 0, i % 200, i % 5 == 0, i % 7 == 0).alias("provider"))


# --------------------------------------------------------------------- windows

PLAN_SQL = HEAD_SQL + """, tot AS (SELECT doc_id, max(line_no // 4 + 1) AS n, 5 AS size, 2 AS back FROM dlines GROUP BY doc_id), st AS (SELECT t.doc_id, n, size, back, coalesce(list(h.page ORDER BY h.ord) FILTER (h.page IS NOT NULL), []) AS s FROM tot t LEFT JOIN hd h USING (doc_id) GROUP BY ALL),
 wn AS (WITH RECURSIVE w AS (SELECT doc_id, n, s, size, back, 0 AS k, 0 AS a, 0 AS z FROM st UNION ALL SELECT doc_id, n, s, size, back, k + 1, z + 1, CASE WHEN b > z + 1 THEN b ELSE i END FROM (SELECT *, list_reduce(list_prepend(0, [p FOR p IN s IF p >= i - back AND p <= i]), lambda b, p: CASE WHEN b = 0 OR p > b THEN p - 1 ELSE b END) AS b FROM (SELECT *, least(z + size, n) AS i FROM w WHERE z < n))) SELECT doc_id, CAST(k AS BIGINT) AS win, CAST(a AS BIGINT) AS start_page, CAST(z AS BIGINT) AS end_page FROM w WHERE k > 0)"""


def windowed(spark, d):
    """(doc_id, n, h, w): documents with their headings and each of their planned windows."""
    starts = F.transform("h", lambda x: x["page"].cast("int"))
    return headed(spark, d).withColumn("s", starts).select("doc_id", "n", "h", F.explode(windows.plan("n", "s", 5, 2)).alias("w"))


def planned(spark, d):
    """windowed with the window in columns win, start_page and end_page."""
    of = {"win": "window", "start_page": "start", "end_page": "end"}
    return windowed(spark, d).select("doc_id", "n", "h", *(F.col(f"w.{x}").cast("long").alias(c) for c, x in of.items()))


def spans(h, n):
    """Headings with the pages from start to end that are theirs: until the page before the next one's, or the document's end."""
    return T.let(h, lambda h: F.transform(h, lambda x, k: F.struct(x["ord"].alias("ord"), x["page"].alias("start"), F.coalesce(F.get(h, k + 1)["page"] - 1, n).alias("end"))))


@query("plan_windows", f"WITH {PLAN_SQL} SELECT * FROM wn")
def plan_windows(spark, d):
    return planned(spark, d).drop("n", "h")


@query("window_context", f"WITH {PLAN_SQL} SELECT doc_id, win, CAST(round(win / count(*) OVER (PARTITION BY doc_id)::DOUBLE * 100) AS BIGINT) AS percent, CAST(ceil((doc_id % 17)::DOUBLE / n * (end_page - start_page + 1)) AS BIGINT) AS images FROM wn JOIN tot USING (doc_id)")
def window_context(spark, d):
    from pyspark.sql import Window

    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return planned(spark, d).select("doc_id", "win", windows.percent("win", total).alias("percent"), windows.expected((F.col("doc_id") % 17).cast("double"), "n", "start_page", "end_page").alias("images"))


@query(
    "window_sections",
    f"WITH {PLAN_SQL}, sx AS (SELECT h.doc_id, h.ord, h.level, h.title, h.page AS s, coalesce(lead(h.page) OVER (PARTITION BY h.doc_id ORDER BY h.ord) - 1, n) AS e FROM hd h JOIN tot USING (doc_id)) SELECT w.doc_id, w.win, CASE WHEN w.start_page > 1 THEN arg_max(x.title, x.ord) FILTER (x.s < w.start_page AND x.level <= 2) END AS continued, coalesce(bool_or(x.s <= w.end_page AND x.e >= w.start_page AND x.e > w.end_page), FALSE) AS goes_on FROM wn w LEFT JOIN sx x USING (doc_id) GROUP BY w.doc_id, w.win, w.start_page",
)
def window_sections(spark, d):
    w = planned(spark, d)
    return w.select("doc_id", "win", windows.continued("h", "start_page").alias("continued"), windows.goes_on(spans(F.col("h"), F.col("n")), "start_page", "end_page").alias("goes_on"))


@query("headings_in_window", f"WITH {PLAN_SQL} SELECT w.doc_id, w.win, h.ord, h.title FROM wn w JOIN hd h ON h.doc_id = w.doc_id AND h.page BETWEEN w.start_page AND w.end_page")
def headings_in_window(spark, d):
    inside = F.filter("h", lambda x: x["page"].between(F.col("start_page"), F.col("end_page")))
    return planned(spark, d).select("doc_id", "win", F.inline(inside)).select("doc_id", "win", "ord", "title")


TREE_SQL = PLAN_SQL + ", sx AS (SELECT h.doc_id, h.ord, h.page AS s, coalesce(lead(h.page) OVER (PARTITION BY h.doc_id ORDER BY h.ord) - 1, n) AS e FROM hd h JOIN tot USING (doc_id))"


@query("sections_in_window", f"WITH {TREE_SQL} SELECT w.doc_id, w.win, x.ord, x.e > w.end_page AS runs_on FROM wn w JOIN sx x ON x.doc_id = w.doc_id AND x.s <= w.end_page AND x.e >= w.start_page")
def sections_in_window(spark, d):
    inside = F.filter(spans(F.col("h"), F.col("n")), lambda x: (x["start"] <= F.col("end_page")) & (x["end"] >= F.col("start_page")))
    return planned(spark, d).select("doc_id", "win", "end_page", F.inline(inside)).select("doc_id", "win", "ord", (F.col("end") > F.col("end_page")).alias("runs_on"))


@query("last_paragraphs", f"WITH {PAGES_SQL} SELECT doc_id, page, coalesce(right([p FOR p IN regexp_split_to_array(text, '\\n\\n+') IF {TRIM.format('p')} <> '' AND NOT starts_with({TRIM.format('p')}, '#')][-1], 500), '') AS last FROM dpages")
def last_paragraphs(spark, d):
    return pages(spark, d).select("doc_id", "page", T.last_paragraph("text").alias("last"))


# ------------------------------------------------------------------ validation

SIM_SQL = """CASE WHEN length(l) = 0 THEN 1.0::DOUBLE WHEN contains(l, s) THEN length(s)::DOUBLE / length(l) ELSE len([c FOR c IN string_split(s, '') IF contains(l, c)])::DOUBLE / length(l) END"""
PAIR_SQL = f"""{LINES_SQL}, pr AS (SELECT doc_id, line_no, line AS a, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM dlines)"""


@query("similarity_ratio", f"WITH {PAIR_SQL} SELECT doc_id, line_no, round({SIM_SQL}, 6) AS similarity FROM (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM pr WHERE b IS NOT NULL)")
def similarity_ratio(spark, d):
    return line_pairs(spark, d).select("doc_id", "line_no", F.round(T.similarity_ratio("a", "b"), 6).alias("similarity"))


def line_pairs(spark, d):
    """Each line but a text's first, with the one before it, from the array of lines."""
    pairs = T.let(T.lines("text"), lambda ls: F.transform(F.slice(ls, F.lit(2), F.size(ls)), lambda a, i: F.struct((i + 1).cast("long").alias("line_no"), a.alias("a"), F.get(ls, i).alias("b"))))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.inline(pairs))


def norm_sql(x):
    return TRIM.format(f"regexp_replace(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '[^A-Za-z0-9_\\s]', '', 'g')")


GRAMS_SQL = "g{0} AS (SELECT doc_id, line_no, substr({0}, i, 2) AS g, count(*) AS c FROM (SELECT *, CAST(unnest(range(1, length({0}))) AS BIGINT) AS i FROM q) GROUP BY ALL)"

HEAD_GRAMS_SQL = "g{0} AS (SELECT doc_id, level, ord, substr({0}, i, 2) AS g, count(*) AS c FROM (SELECT *, CAST(unnest(range(1, length({0}))) AS BIGINT) AS i FROM q) GROUP BY ALL)"


@query(
    "dice_similarity",
    f"WITH {PAIR_SQL}, q AS (SELECT doc_id, line_no, regexp_replace({norm_sql('a')}, '\\s', '', 'g') AS a, regexp_replace({norm_sql('b')}, '\\s', '', 'g') AS b FROM pr WHERE b IS NOT NULL), {GRAMS_SQL.format('a')}, {GRAMS_SQL.format('b')}, cm AS (SELECT doc_id, line_no, sum(least(ga.c, gb.c)) AS s FROM ga JOIN gb USING (doc_id, line_no, g) GROUP BY ALL) SELECT doc_id, line_no, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN length(a) < 2 OR length(b) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(s, 0)::DOUBLE / (length(a) + length(b) - 2) END, 6) AS similarity FROM q LEFT JOIN cm USING (doc_id, line_no)",
)
def dice_similarity(spark, d):
    return line_pairs(spark, d).select("doc_id", "line_no", F.round(T.dice(T.match_plain("a"), T.match_plain("b")), 6).alias("similarity"))


MATCH_SQL = f"""{HEAD_SQL}, ex AS (SELECT doc_id, ord, level, title || ' x' AS text, title FROM hd), q AS (SELECT *, regexp_replace({norm_sql('text')}, '\\s', '', 'g') AS a, regexp_replace({norm_sql('title')}, '\\s', '', 'g') AS b FROM ex),
 {HEAD_GRAMS_SQL.format('a')}, {HEAD_GRAMS_SQL.format('b')}, cm AS (SELECT doc_id, ga.ord, gb.ord AS mo, sum(least(ga.c, gb.c)) AS s FROM ga JOIN gb USING (doc_id, level, g) GROUP BY ALL),
 sm AS (SELECT e.doc_id, e.ord, e.level, e.text, h.title AS m, h.ord AS mo, round(CASE WHEN e.a = h.b THEN 1.0::DOUBLE WHEN length(e.a) < 2 OR length(h.b) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(cm.s, 0)::DOUBLE / (length(e.a) + length(h.b) - 2) END, 6) AS sim FROM q e JOIN q h ON h.doc_id = e.doc_id AND h.level = e.level LEFT JOIN cm ON cm.doc_id = e.doc_id AND cm.ord = e.ord AND cm.mo = h.ord)"""


@query(
    "heading_best_match",
    f"WITH {MATCH_SQL} SELECT doc_id, ord, level, text, m AS match, sim AS similarity, sim >= 0.9 AS matched FROM sm QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY sim DESC, mo) = 1",
)
def heading_best_match(spark, d):
    h = headings(spark, d).select("doc_id", "ord", "level", F.col("title").alias("text"))
    expected = h.withColumn("text", F.concat("text", F.lit(" x")))
    return validation.best_matches(expected, h)


REPORT_SQL = f"""WITH {MATCH_SQL}, b AS (SELECT doc_id, ord, max(sim) >= 0.9 AS matched FROM sm GROUP BY doc_id, ord), m AS (SELECT doc_id, count(*) AS n, count(*) FILTER (matched) AS k FROM b GROUP BY doc_id),
 c AS (SELECT doc_id, {', '.join(f'count(*) FILTER (level = {k}) AS h{k}' for k in range(1, 7))}, count(*) FILTER (prev > 0 AND level > prev + 1) AS e FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM hd) GROUP BY doc_id)
 SELECT doc_id, {', '.join(f'CAST(h{k} AS BIGINT) AS h{k}' for k in range(1, 7))}, CAST(e AS BIGINT) AS hierarchy_errors, CAST(n AS BIGINT) AS expected, CAST(k AS BIGINT) AS matched, e = 0 AS hierarchy_valid FROM c JOIN m USING (doc_id)"""


@query("structure_report", REPORT_SQL)
def structure_report(spark, d):
    h = headings(spark, d).select("doc_id", "ord", "level", F.col("title").alias("text"))
    return validation.structure_report(h.withColumn("text", F.concat("text", F.lit(" x"))), h)


@query("content_report", "SELECT doc_id, abs(doc_id % 5 - doc_id % 3) <= 1 AS images_ok, abs(doc_id % 7 - doc_id % 4) <= 1 AS tables_ok, abs(doc_id % 6 - doc_id % 5) <= 1 AS code_blocks_ok, abs(doc_id % 5 - doc_id % 3) <= 1 AND abs(doc_id % 7 - doc_id % 4) <= 1 AND abs(doc_id % 6 - doc_id % 5) <= 1 AS content_ok FROM documents")
def content_report(spark, d):
    counts = lambda a, b, c: F.struct((F.col("doc_id") % a).alias("images"), (F.col("doc_id") % b).alias("tables"), (F.col("doc_id") % c).alias("code_blocks"))
    return docs(spark, d).select("doc_id", counts(5, 7, 6).alias("a"), counts(3, 4, 5).alias("e")).select("doc_id", *validation.content_report("a", "e"))


@query("content_tolerance", "SELECT doc_id, abs((doc_id % 5) - (doc_id % 3)) <= 1 AS images_ok, abs((doc_id % 7) - (doc_id % 4)) <= 1 AS tables_ok FROM documents")
def content_tolerance(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", validation.within(i % 5, i % 3).alias("images_ok"), validation.within(i % 7, i % 4).alias("tables_ok"))


BROKEN_SQL = "text || ' ![x]( ) [open ' || CASE WHEN doc_id % 2 = 0 THEN '](tail' ELSE '' END"


@query("format_warnings", f"SELECT doc_id, {TRIM.format('t')} <> '' AS parseable, CAST(len(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(\\s*\\)')) AS BIGINT) AS broken_images, CAST(len(regexp_extract_all(t, '\\[')) - len(regexp_extract_all(t, '\\]')) AS BIGINT) AS open_brackets, regexp_matches(t, '(?m)\\]\\([^)]*$') AS open_link, CAST(len([x FOR x IN string_split(t, chr(10)) IF length(x) > 500]) AS BIGINT) AS long_lines FROM (SELECT doc_id, {BROKEN_SQL} AS t FROM documents WHERE text IS NOT NULL)")
def format_warnings(spark, d):
    t = F.concat(F.col("text"), F.lit(" ![x]( ) [open "), F.when(F.col("doc_id") % 2 == 0, "](tail").otherwise(""))
    return docs(spark, d).where("text IS NOT NULL").withColumn("t", t).select("doc_id", *validation.format_warnings("t"))


ELEMENTS_SQL = "repeat('#', CAST(doc_id % 6 + 1 AS INT)) || ' A' || chr(10) || repeat('```py' || chr(10) || '# no' || chr(10) || '```' || chr(10), CAST(doc_id % 3 AS INT)) || repeat(chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |' || chr(10), CAST(doc_id % 4 AS INT)) || repeat('![i](u)' || chr(10), CAST(doc_id % 5 AS INT)) || text"
FENCE = "'(?ms)^```.*?^```[ \\t]*$'"


def matches_sql(x, pattern, name):
    return f"CAST(len(regexp_extract_all({x}, {pattern})) AS BIGINT) AS {name}"


@query(
    "markdown_elements",
    f"SELECT doc_id, {', '.join(matches_sql('o', f"'(?m)^#{{{k}}}[ \\t]+[^ \\t\\r\\n\\f\\v]'", f'h{k}') for k in range(1, 7))}, {matches_sql('o', "'!\\[[^\\]]*\\]\\([^)]*\\)'", 'images')}, {matches_sql('o', "'(?m)^\\|?[ \\t]*:?-+:?[ \\t]*(?:\\|[ \\t]*:?-+:?[ \\t]*)+\\|?[ \\t]*$'", 'tables')}, {matches_sql('t', FENCE, 'code_blocks')} FROM (SELECT doc_id, t, regexp_replace(t, {FENCE}, '', 'g') AS o FROM (SELECT doc_id, {ELEMENTS_SQL} AS t FROM documents WHERE text IS NOT NULL))",
)
def markdown_elements(spark, d):
    times = lambda what, k: F.repeat(F.lit(what), (F.col("doc_id") % k).cast("int"))
    md = F.concat(F.repeat(F.lit("#"), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" A\n"), times("```py\n# no\n```\n", 3), times("\n| a | b |\n|---|:-:|\n| 1 | 2 |\n", 4), times("![i](u)\n", 5), F.col("text"))
    return docs(spark, d).where("text IS NOT NULL").withColumn("t", md).select("doc_id", *validation.elements("t"))


# -------------------------------------------------------------------- geometry


def boxes(spark, d):
    """Three painted paths for each page row, from its id."""
    i = F.col("page_id")
    return corpus.table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select(
        "page_id", F.col("k").cast("long").alias("seq"), ((i * 31 + F.col("k") * 97) % 400).cast("double").alias("min_x"), ((i * 17 + F.col("k") * 41) % 300).cast("double").alias("min_y"),
        ((i * 31 + F.col("k") * 97) % 400 + 20 + (i + F.col("k")) % 150).cast("double").alias("max_x"), ((i * 17 + F.col("k") * 41) % 300 + 10 + (i * 3 + F.col("k")) % 90).cast("double").alias("max_y"),
        ((i + F.col("k")) % 2 == 0).alias("has_stroke"), ((i + F.col("k")) % 3 == 0).alias("has_fill"), ((i + F.col("k") * 2) % 9 + 1).cast("int").alias("path_ops"),
    )


BOX_SQL = """bx AS (SELECT page_id, k AS seq, ((page_id * 31 + k * 97) % 400)::DOUBLE AS min_x, ((page_id * 17 + k * 41) % 300)::DOUBLE AS min_y, ((page_id * 31 + k * 97) % 400 + 20 + (page_id + k) % 150)::DOUBLE AS max_x, ((page_id * 17 + k * 41) % 300 + 10 + (page_id * 3 + k) % 90)::DOUBLE AS max_y, (page_id + k) % 2 = 0 AS has_stroke, (page_id + k) % 3 = 0 AS has_fill, (page_id + k * 2) % 9 + 1 AS path_ops FROM (SELECT page_id, unnest(range(5)) AS k FROM pages)),
 nr AS (SELECT a.page_id, a.seq AS a, b.seq AS b FROM bx a JOIN bx b ON a.page_id = b.page_id AND greatest(0, greatest(a.min_x, b.min_x) - least(a.max_x, b.max_x)) <= 15 AND greatest(0, greatest(a.min_y, b.min_y) - least(a.max_y, b.max_y)) <= 15),
 rc AS (WITH RECURSIVE r AS (SELECT page_id, a, b FROM nr UNION SELECT r.page_id, r.a, nr.b FROM r JOIN nr ON nr.page_id = r.page_id AND nr.a = r.b) SELECT page_id, a AS seq, min(b) AS cluster FROM r GROUP BY page_id, a),
 cl AS (SELECT page_id, cluster, min(min_x) AS x, min(min_y) AS y, max(max_x) - min(min_x) AS width, max(max_y) - min(min_y) AS height, CAST(sum(path_ops) AS BIGINT) AS path_count, bool_or(has_stroke) AS has_stroke, bool_or(has_fill) AS has_fill, least(1.0, sum(path_ops) / 100.0::DOUBLE)::DOUBLE AS complexity FROM bx JOIN rc USING (page_id, seq) GROUP BY ALL HAVING count(*) >= 2 OR arg_min(path_ops, seq) >= 5)"""


@query("cluster_paths", f"WITH {BOX_SQL} SELECT * FROM cl")
def cluster_paths(spark, d):
    return geometry.clusters(boxes(spark, d)).drop("kind")


@query("classify_regions", f"WITH {BOX_SQL} SELECT page_id, cluster, CASE WHEN width < 200 AND height < 200 AND ar > 0.5 AND ar < 2 AND has_fill THEN 'logo' WHEN (ar > 10 OR ar < 0.1) AND path_count < 5 THEN 'decoration' WHEN path_count > 20 AND has_stroke AND has_fill THEN 'diagram' WHEN ar > 0.5 AND ar < 3 AND path_count > 10 THEN 'chart' ELSE 'unknown' END AS kind FROM (SELECT *, width / CASE WHEN height = 0 THEN 1 ELSE height END AS ar FROM cl)")
def classify_regions(spark, d):
    return geometry.clusters(boxes(spark, d)).select("page_id", "cluster", "kind")


@query("path_bounds", "SELECT page_id, CAST(2 AS BIGINT) AS seq, (page_id % 50)::DOUBLE AS min_x, (800 - (page_id % 40 + 60))::DOUBLE AS min_y, (page_id % 50 + 100)::DOUBLE AS max_x, (800 - page_id % 40)::DOUBLE AS max_y, page_id % 2 = 0 AS has_stroke, page_id % 2 = 1 AS has_fill, CAST(3 AS BIGINT) AS path_ops FROM pages")
def path_bounds(spark, d):
    i = F.col("page_id")
    x, y = (i % 50).cast("double"), (i % 40).cast("double")
    none = F.array().cast("array<int>"), F.array().cast("array<double>")

    def op(seq, number, sub=none[0], coords=none[1]):
        return F.struct(F.lit(seq).cast("long").alias("seq"), (number if not isinstance(number, int) else F.lit(number)).alias("op"), sub.alias("sub_ops"), coords.alias("coords"))

    paint = F.when(i % 2 == 0, geometry.STROKE).otherwise(geometry.FILL)
    sub = F.array(F.lit(geometry.MOVE), F.lit(geometry.RECT), F.lit(geometry.CLOSE))
    ops = F.array(
        op(0, geometry.RECTANGLE, coords=F.array(x, y, x, y)),  # replaced before it is painted
        op(1, geometry.CONSTRUCT, sub, F.array(x, y, x + 50, y + 10, F.lit(50.0), F.lit(50.0))),
        op(2, paint),
        op(3, geometry.FILL),  # nothing is left to paint
        op(4, geometry.BEGIN_TEXT),
        op(5, geometry.RECTANGLE, coords=F.array(x, y, x + 99, y + 99)),
        op(6, geometry.FILL),
        op(7, geometry.END_TEXT),
    )
    stream = corpus.table(spark, d, "pages").select("page_id", F.explode(ops).alias("o")).select("page_id", "o.*")
    return geometry.painted_paths(stream, height=800.0).withColumn("path_ops", F.col("path_ops").cast("long"))


@query("crop_boxes", "SELECT page_id, (page_id % 500) / 1000.0::DOUBLE * 640 AS x, (page_id % 300) / 1000.0::DOUBLE * 480 AS y, CAST(floor(250 / 1000.0::DOUBLE * 640) AS BIGINT) AS w, CAST(floor(333 / 1000.0::DOUBLE * 480) AS BIGINT) AS h FROM pages")
def crop_boxes(spark, d):
    i = F.col("page_id")
    box = geometry.crop_box(i % 300, i % 500, i % 300 + 333, i % 500 + 250, F.lit(640), F.lit(480))
    return corpus.table(spark, d, "pages").select("page_id", box.alias("b")).select("page_id", "b.*")


@query("svg_placeholders", "SELECT page_id, '<svg xmlns=\"http://www.w3.org/2000/svg\" viewBox=\"' || v || '\"><rect x=\"1\" y=\"2\" width=\"' || page_id || '\" height=\"9\" fill=\"none\"/><text>[Vector Graphic: chart]</text></svg>' AS svg FROM (SELECT page_id, '1 2 ' || page_id || ' 9' AS v FROM pages)")
def svg_placeholders(spark, d):
    s = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    return corpus.table(spark, d, "pages").select("page_id", geometry.svg_placeholder(s("1"), s("2"), s(F.col("page_id")), s("9"), F.lit("chart")).alias("svg"))


WINDOW_SQL = f"""{PAGED_SQL}, wd AS (SELECT doc_id, i, c, t, coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY i), '') AS nx FROM (SELECT doc_id, i, ceil(n / 2.0) AS c, array_to_string(pages[i * 2 - 1 : i * 2], chr(10) || chr(10)) AS t FROM (SELECT doc_id, n, pages, unnest(range(1, CAST(ceil(n / 2.0) AS BIGINT) + 1)) AS i FROM paged))),
 wl AS (SELECT *, coalesce(right([p FOR p IN regexp_split_to_array(t, '\\n\\n+') IF {TRIM.format('p')} <> '' AND NOT starts_with({TRIM.format('p')}, '#')][-1], 500), '') AS tail, regexp_replace(nx, '^\\s+', '') AS ns FROM wd)"""


@query("merge_windows", f"WITH {WINDOW_SQL} SELECT doc_id, md5(string_agg(CASE WHEN i < c AND tail <> '' AND NOT regexp_matches(tail, '[.!?:;''\"]$') AND (regexp_matches(ns, '^[a-z]') OR NOT starts_with(ns, '#')) THEN regexp_replace(t, '\\s+$', '') || ' ' ELSE {TRIM.format('t')} END, chr(10) || chr(10) ORDER BY i)) AS markdown_md5 FROM wl GROUP BY doc_id")
def merge_windows(spark, d):
    from pagemill.operators import sections as S

    two = F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / 2).cast("int")), lambda i: F.array_join(F.slice("pages", i * 2 - 1, F.lit(2)), "\n\n"))
    return paged(spark, d).withColumn("w", two).select("doc_id", F.md5(S.merged_windows("w")).alias("markdown_md5"))


FILTERED_SQL = f"""{LINES_SQL}, fp AS (SELECT doc_id, line_no, line, lower({TRIM.format('line')}) AS a, lower({TRIM.format('first_value(line) OVER (PARTITION BY doc_id ORDER BY line_no)')}) AS b FROM dlines),
 fs AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM fp)"""


@query("line_filter_repeated", f"WITH {FILTERED_SQL} SELECT doc_id, md5({TRIM.format("coalesce(string_agg(CASE WHEN a = '' OR NOT (a = b OR (length(a) > 5 AND length(b) > 5 AND " + SIM_SQL + " > 0.8) OR regexp_matches(a, '^\\s*\\d+\\s*$')) THEN line END, chr(10) ORDER BY line_no), '')")}) AS text_md5 FROM fs GROUP BY doc_id")
def line_filter_repeated(spark, d):
    from pagemill.operators import sections as S

    first = F.array(F.get(T.lines("text"), F.lit(0)))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(S.without_lines("text", first, r"^\s*\d+\s*$")).alias("text_md5"))


@query(
    "outline_depth",
    f"WITH {HEAD_SQL}, pa AS (SELECT h.doc_id, h.ord, (SELECT max(p.ord) FROM hd p WHERE p.doc_id = h.doc_id AND p.ord < h.ord AND p.level < h.level) AS parent FROM hd h), dp AS (WITH RECURSIVE r AS (SELECT doc_id, ord, 1 AS depth FROM pa WHERE parent IS NULL UNION ALL SELECT pa.doc_id, pa.ord, r.depth + 1 FROM r JOIN pa ON pa.doc_id = r.doc_id AND pa.parent = r.ord) SELECT * FROM r) SELECT doc_id, CAST(max(depth) AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS entries FROM dp GROUP BY doc_id",
)
def outline_depth(spark, d):
    from pagemill.operators import sections as S

    per = headed(spark, d).where(F.size("h") > 0)
    return per.select("doc_id", F.array_max(S.outline_depths(levels_of("h"))).cast("long").alias("depth"), F.size("h").cast("long").alias("entries"))
