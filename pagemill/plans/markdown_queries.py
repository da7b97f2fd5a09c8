"""Walks over Markdown whose tables and fenced blocks are made of the documents' pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import validation
from pagemill.plans.base import PAGED_SQL, paged, query

# A page's lines are the rows of a table, each line so many times a cell as the first one's length tells; then a block.
BLOCKS_SQL = f"""{PAGED_SQL}, ls AS (SELECT doc_id, i, string_split(pages[i + 1], chr(10)) AS l FROM (SELECT doc_id, pages, unnest(range(n)) AS i FROM paged)),
shape AS (SELECT doc_id, i, len(l) AS r, 1 + length(l[1]) % 4 AS c, CASE length(l[1]) % 3 WHEN 0 THEN 'python' WHEN 1 THEN '' ELSE 'sql' END AS lang FROM ls)"""


def tables_and_blocks(pages):
    def page(p):
        ls = F.split(p, "\n")
        size = F.length(F.get(ls, F.lit(0)))
        n = size % 4 + 1
        row = lambda x: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.replace(x, F.lit("|"), F.lit("\\|")), n), " | "), F.lit(" |"))
        rows = F.transform(ls, row)
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n))
        name = F.when(size % 3 == 0, "python").when(size % 3 == 1, "").otherwise("sql")
        parts = F.concat(F.slice(rows, F.lit(1), F.lit(1)), F.array(rule), F.slice(rows, F.lit(2), F.size(rows)), F.array(F.lit(""), F.concat(F.lit("```"), name), F.lit("| a | b |"), F.lit("|---|---|"), F.lit("```"), F.lit("")))
        return F.array_join(parts, "\n")

    return F.array_join(F.transform(pages, page), "\n")


@query(
    "markdown_blocks",
    f"WITH {BLOCKS_SQL} SELECT doc_id, string_agg(r || 'x' || c, ',' ORDER BY i) AS tables, string_agg(lang, ',' ORDER BY i) AS languages FROM shape GROUP BY doc_id",
)
def markdown_blocks(spark, d):
    found = paged(spark, d).select("doc_id", validation.blocks(tables_and_blocks(F.col("pages"))).alias("b"))
    shapes = F.transform("b.tables", lambda t: F.concat_ws("x", t["rows"].cast("string"), t["columns"].cast("string")))
    return found.select("doc_id", F.array_join(shapes, ",").alias("tables"), F.array_join("b.languages", ",").alias("languages"))


@query(
    "content_by_blocks",
    f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS tables, CAST(count(*) AS BIGINT) AS code_blocks, abs(count(*) - 2) <= 2 AS tables_ok, abs(count(*) - 3) <= 2 AS code_blocks_ok FROM shape GROUP BY doc_id",
)
def content_by_blocks(spark, d):
    found = paged(spark, d).select("doc_id", validation.content_of(tables_and_blocks(F.col("pages"))).alias("a"))
    wanted = F.struct(F.lit(0).cast("long").alias("images"), F.lit(2).cast("long").alias("tables"), F.lit(3).cast("long").alias("code_blocks"))
    report = validation.content_report("a", "e", 2)
    return found.withColumn("e", wanted).select("doc_id", "a.tables", "a.code_blocks", *report).drop("images_ok", "content_ok")
