"""Queries over whole conversions and over failing calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import execution, pipelines
from pagemill.operators import sections as S
from pagemill.plans.base import PAGED_SQL, paged, pages, query
from pagemill.plans.content_queries import DEFS, MD_SQL, TRIM, marked
from pagemill.plans.conversion_sql import FULL, HTML, INTELLIGENT, LIGHT, organized
from pagemill.plans.text_queries import FACTORS_SQL, PLAN_SQL, presence_sql
from pagemill.sources import corpus


def digest(df):
    return df.select("doc_id", F.md5("markdown").alias("markdown_md5"), "language", "n_pages", "pipeline")


DIRECT = "WITH {2} SELECT doc_id, md5(array_to_string(pages, chr(10) || chr(10))) AS markdown_md5, {1} AS language, n AS n_pages, 'direct' AS pipeline FROM (SELECT *, {0} FROM paged)".format(*presence_sql("pages[1]"), PAGED_SQL)
ADAPTIVE = f"WITH {FACTORS_SQL}, {PLAN_SQL} " + " UNION ALL ".join(f"SELECT c.* FROM ({x}) c JOIN plan p ON p.doc_id = c.doc_id AND p.pipeline = c.pipeline" for x in (DIRECT, LIGHT, FULL, INTELLIGENT))


@query("convert_direct", DIRECT)
def convert_direct(spark, d):
    return digest(pipelines.convert(paged(spark, d), "direct"))


@query("convert_light", LIGHT)
def convert_light(spark, d):
    return digest(pipelines.convert(paged(spark, d), "light"))


@query("convert_full", FULL)
def convert_full(spark, d):
    return digest(pipelines.convert(paged(spark, d), "full"))


@query("convert_intelligent", INTELLIGENT)
def convert_intelligent(spark, d):
    return digest(pipelines.convert(paged(spark, d), "intelligent"))


@query("convert_adaptive", ADAPTIVE)
def convert_adaptive(spark, d):
    return digest(pipelines.adaptive(paged(spark, d)))


MARKED = f"WITH {MD_SQL}, {organized('SELECT doc_id, page, ' + TRIM.format(f"regexp_replace(regexp_replace(text, {DEFS}, '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')") + " AS text, '' AS last FROM mdp", 6, False, False)} SELECT doc_id, markdown FROM mg"


@query("assemble_document", MARKED)
def assemble_document(spark, d):
    all_ = F.flatten(F.transform("pages", lambda t: S.parse(S.without_footnotes(t))))
    return marked(spark, d).select("doc_id", S.assembled(all_).alias("markdown"))


@query("adaptive_mix", f"WITH {FACTORS_SQL}, {PLAN_SQL} SELECT pipeline, CAST(count(*) AS BIGINT) AS documents, CAST(sum(page_count) AS BIGINT) AS n_pages FROM plan GROUP BY pipeline")
def adaptive_mix(spark, d):
    got = pipelines.with_plan(paged(spark, d))
    return got.groupBy("pipeline").agg(F.count(F.lit(1)).cast("long").alias("documents"), F.sum("n").cast("long").alias("n_pages"))


@query("html_to_markdown", f"SELECT page_id, {HTML} AS markdown FROM pages")
def html_to_markdown(spark, d):
    return corpus.spread(corpus.table(spark, d, "pages").select("page_id", "html")).select("page_id", corpus.html_to_markdown("html").alias("markdown"))


def flaky(row: dict) -> str:
    """Fails for some pages in ways that a provider does."""
    k = (row["doc_id"] * 7 + row["page"]) % 20
    if k == 3:
        raise RuntimeError("status: 503 unavailable")
    if k == 5:
        raise RuntimeError("Rate limit reached")
    if k == 8:
        raise ValueError("bad page")
    return f"{row['doc_id']}-{row['page']}"


@query(
    "robust_errors",
    f"WITH {PAGED_SQL}, e AS (SELECT doc_id, CAST(i AS BIGINT) AS page, CASE (doc_id * 7 + i) % 20 WHEN 3 THEN 'api' WHEN 5 THEN 'rate_limit' WHEN 8 THEN 'api' END AS kind FROM (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM paged)) SELECT doc_id, CAST(count(*) AS BIGINT) AS pages, coalesce(string_agg(page || ':' || kind, ',' ORDER BY page) FILTER (kind IS NOT NULL), '') AS errors, count(kind) = 0 AS full_success FROM e GROUP BY doc_id",
)
def robust_errors(spark, d):
    called = execution.robust_calls(pages(spark, d).select("doc_id", "page"), flaky, waits=())
    return execution.error_rollup(called)


@query("label_language_quality", "SELECT lang, CAST(count(*) AS BIGINT) AS labelled, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_language_quality(spark, d):
    joined = corpus.table(spark, d, "documents").select("doc_id", "lang").join(corpus.table(spark, d, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).cast("long").alias("labelled"), F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


