"""Queries over the rows of a PDF reader; items, operators, objects and outlines are derived from the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import geometry
from pagemill.plans.base import LINES_SQL, PAGED_SQL, PAGES_SQL, docs, paged, pages, query
from pagemill.sources import corpus, pdf, pdf_content, pdf_objects, pdf_writer, shared

ITEMS_SQL = f"{LINES_SQL}, items AS (SELECT doc_id, line_no // 4 + 1 AS page, line_no AS seq, line AS text FROM dlines)"


@query("page_text_from_items", f"WITH {ITEMS_SQL} SELECT doc_id, page, string_agg(text, ' ' ORDER BY seq) AS text FROM items GROUP BY doc_id, page")
def page_text_from_items(spark, d):
    ls = corpus.exploded_lines(docs(spark, d))
    return pdf.page_texts(ls.select("doc_id", (F.floor(F.col("line_no") / 4) + 1).alias("page"), F.col("line_no").alias("seq"), F.col("line").alias("text")))


@query("page_range", f"WITH {PAGES_SQL} SELECT doc_id, page, text FROM dpages WHERE page BETWEEN 2 AND 3")
def page_range(spark, d):
    return corpus.page_range(pages(spark, d), 2, 3)


# An operator for each word of each page: every ninth paints an image, whose object now and then has no data or no size.
OPS_SQL = f"{PAGES_SQL}, ops AS (SELECT doc_id, page, CAST(j AS BIGINT) AS seq, 80 + CAST((doc_id + page + j) % 9 AS INT) AS op, 'im' || (j % 7) AS name FROM (SELECT doc_id, page, unnest(range(1, len(string_split(text, ' ')) + 1)) AS j FROM dpages)), obj AS (SELECT doc_id, page, 'im' || k AS name, CASE WHEN (doc_id + k) % 4 <> 0 THEN 'd' || k END AS data, CASE WHEN (page + k) % 5 <> 0 THEN 10 + k END AS width, (doc_id + k) % 6 AS height FROM (SELECT doc_id, page, unnest(range(6)) AS k FROM dpages)), im AS (SELECT doc_id, page, seq, width, height, data FROM ops JOIN obj USING (doc_id, page, name) WHERE op IN (85, 86, 87) AND data IS NOT NULL AND width > 0 AND height > 0)"


def images(spark, d):
    p = pages(spark, d)
    words = p.select("doc_id", "page", F.explode(F.sequence(F.lit(1).cast("long"), F.size(F.split("text", " ")).cast("long"))).alias("seq"))
    ops = words.select("doc_id", "page", "seq", (80 + (F.col("doc_id") + F.col("page") + F.col("seq")) % 9).cast("int").alias("op"), F.concat(F.lit("im"), (F.col("seq") % 7).cast("string")).alias("name"))
    k = F.col("k")
    own = p.select("doc_id", "page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"))
    objects = own.select("doc_id", "page", F.concat(F.lit("im"), k.cast("string")).alias("name"), F.when((F.col("doc_id") + k) % 4 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("data"), F.when((F.col("page") + k) % 5 != 0, 10 + k).alias("width"), ((F.col("doc_id") + k) % 6).alias("height"))
    return pdf.embedded_images(ops, objects)


@query("embedded_images", f"WITH {OPS_SQL} SELECT * FROM im")
def embedded_images(spark, d):
    return images(spark, d)


@query("image_counts", f"WITH {OPS_SQL} SELECT p.doc_id, p.page, CAST(count(im.seq) AS BIGINT) AS images FROM dpages p LEFT JOIN im USING (doc_id, page) GROUP BY p.doc_id, p.page")
def image_counts(spark, d):
    return pdf.image_counts(pages(spark, d), images(spark, d))


@query("outline_pages", f"WITH {LINES_SQL} SELECT doc_id, line_no AS node, CASE WHEN line_no > 0 THEN line_no // 2 END AS parent, line AS title, CASE WHEN line_no % 3 <> 0 AND line_no % 5 <> 0 THEN line_no // 4 + 1 END AS page FROM dlines WHERE line <> ''")
def outline_pages(spark, d):
    ls = corpus.exploded_lines(docs(spark, d)).where("line <> ''")
    n = F.col("line_no")
    nodes = ls.select("doc_id", n.alias("node"), F.when(n > 0, F.floor(n / 2)).alias("parent"), F.col("line").alias("title"), F.when(n % 3 != 0, F.concat(F.lit("d"), n.cast("string"))).alias("dest"))
    known = ls.where(n % 5 != 0).select("doc_id", F.concat(F.lit("d"), n.cast("string")).alias("dest"), F.floor(n / 4).alias("page_index"))
    return pdf.outline_pages(nodes, known)


# Files written from the documents and read again: a page for four lines, an outline entry, a drawn box and a picture for each page.
FILES_SQL = f"{PAGED_SQL}, files AS (SELECT doc_id, CAST(i + 1 AS BIGINT) AS page, string_split(pages[i + 1], chr(10)) AS ls FROM (SELECT doc_id, pages, unnest(range(n)) AS i FROM paged))"


def files(spark, d):
    """(doc_id, content): a PDF file of each document."""
    p = paged(spark, d).select("doc_id", F.transform("pages", lambda x: F.split(x, "\n")).alias("pages"))
    size = lambda ls, k: F.coalesce(F.length(F.get(ls, F.lit(k))), F.lit(0)).cast("string")
    box = lambda ls: F.concat(F.lit("q 2 0 0 2 10 20 cm q 1 0 0 1 5 5 cm "), size(ls, 0), F.lit(" "), size(ls, 1), F.lit(" 30 10 re S Q 0 0 m "), size(ls, 2), F.lit(" 40 l B Q"))
    first = F.get(F.get("pages", F.lit(0)), F.lit(0))
    return pdf_writer.text_files(p.select("doc_id", "pages", first.alias("title"), F.transform("pages", lambda ls: F.get(ls, F.lit(0))).alias("titles"), F.transform("pages", box).alias("marks"), F.encode(F.substring(F.concat(F.lit("p"), first), 1, 50), "UTF-8").alias("picture")))


def read_back(spark, d):
    """Object rows and pages of the files."""
    objs = shared.written(pdf_objects.objects(files(spark, d)), "objects")
    return objs, shared.written(pdf_objects.page_nodes(objs), "pages")


@query("pdf_metadata", f"WITH {PAGED_SQL} SELECT doc_id, n AS page_count, string_split(pages[1], chr(10))[1] AS title FROM paged")
def pdf_metadata(spark, d):
    return pdf_objects.metadata(*read_back(spark, d)).select("doc_id", "page_count", "title")


@query("pdf_page_texts", f"WITH {FILES_SQL} SELECT doc_id, page, array_to_string(ls, ' ') AS text FROM files")
def pdf_page_texts(spark, d):
    return pdf_content.page_texts(*read_back(spark, d))


@query("pdf_outline", f"WITH {FILES_SQL} SELECT doc_id, page - 1 AS ordinal, (page - 1) % 2 AS depth, ls[1] AS title, page FROM files")
def pdf_outline(spark, d):
    objs, pages = read_back(spark, d)
    return pdf_objects.outline(objs, pages, pdf_objects.destinations(objs, pages)).select("doc_id", "ordinal", "depth", "title", "page")


@query("pdf_images", f"WITH {FILES_SQL} SELECT doc_id, page, CAST(strlen(t) AS BIGINT) AS width, CAST(1 AS BIGINT) AS height, sha256(t) AS samples FROM files JOIN (SELECT doc_id, 'p' || substring(ls[1], 1, 49) AS t FROM files WHERE page = 1) USING (doc_id)")
def pdf_images(spark, d):
    objs, pages = read_back(spark, d)
    found = pdf_content.images(objs, pages, pdf_content.shown(objs, pages, (pdf_content.PICTURE, pdf_content.INLINE)))
    return found.select("doc_id", "page", "width", "height", F.sha2("data", 256).alias("samples"))


# A box of 30 x 10 moved by (5, 5), doubled and moved by (10, 20); a line from there, doubled as well.
PATHS_SQL = f"""{FILES_SQL}, sizes AS (SELECT doc_id, page, coalesce(length(ls[1]), 0) AS a, coalesce(length(ls[2]), 0) AS b, coalesce(length(ls[3]), 0) AS c FROM files),
drawn AS (SELECT doc_id, page, 0 AS k, 2 * (a + 5) + 10 AS min_x, 792 - (2 * (b + 15) + 20) AS min_y, 2 * (a + 35) + 10 AS max_x, 792 - (2 * (b + 5) + 20) AS max_y, false AS has_fill FROM sizes
UNION ALL SELECT doc_id, page, 1, 10, 792 - 100, 10 + 2 * c, 792 - 20, true FROM sizes)"""


@query("pdf_painted_paths", f"WITH {PATHS_SQL} SELECT doc_id, page, CAST(min_x AS DOUBLE) AS min_x, CAST(min_y AS DOUBLE) AS min_y, CAST(max_x AS DOUBLE) AS max_x, CAST(max_y AS DOUBLE) AS max_y, has_fill FROM drawn WHERE max_x - min_x >= 20 OR max_y - min_y >= 20")
def pdf_painted_paths(spark, d):
    objs, pages = read_back(spark, d)
    drawn = pdf_content.drawn(pdf_content.shown(objs, pages, pdf_content.DRAWING), pages, placed=True)
    paths = geometry.painted_paths(drawn, height=F.col("height"))
    return paths.select("page_id.doc_id", "page_id.page", "min_x", "min_y", "max_x", "max_y", "has_fill")
