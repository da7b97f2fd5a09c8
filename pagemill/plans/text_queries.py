"""Queries over samples, detectors and document features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import features, sampling
from pagemill.plans.base import LINES_SQL, PAGED_SQL, PAGES_SQL, docs, joined, paged, pages, query
from pagemill.sources import corpus


@query("paginate_documents", f"WITH {PAGES_SQL} SELECT doc_id, page, text, CAST(length(text) AS BIGINT) AS n_chars FROM dpages")
def paginate_documents(spark, d):
    return pages(spark, d).withColumn("n_chars", F.length("text").cast("long"))


FML_SQL = "CASE WHEN n <= 3 THEN range(1, n + 1) ELSE [1, n // 2, n] END"


@query("sample_pages_fml", f"WITH {PAGED_SQL} SELECT doc_id, n, array_to_string({FML_SQL}, ',') AS sample FROM paged")
def sample_pages_fml(spark, d):
    return paged(spark, d).select("doc_id", "n", joined(sampling.first_middle_last("n")).alias("sample"))


@query("sample_pages_pct", f"WITH {PAGED_SQL} SELECT doc_id, n, array_to_string(list_sort(list_distinct([greatest(1, least(n, CAST(floor((p / 100.0::DOUBLE) * (n - 1)) AS BIGINT) + 1)) FOR p IN [10, 30, 50, 70, 90]])), ',') AS sample FROM paged")
def sample_pages_pct(spark, d):
    return paged(spark, d).select("doc_id", "n", joined(sampling.at_percentiles("n")).alias("sample"))


@query("sample_pages_structure", f"WITH {PAGED_SQL} SELECT doc_id, n, array_to_string(list_sort(CASE WHEN n <= 10 THEN range(1, n + 1) ELSE list_distinct([greatest(1, least(n, CAST(floor(q::DOUBLE * n + 0.5::DOUBLE) AS BIGINT))) FOR q IN [0.05, 0.20, 0.40, 0.60, 0.80, 0.95]]) END), ',') AS sample FROM paged")
def sample_pages_structure(spark, d):
    return paged(spark, d).select("doc_id", "n", joined(sampling.for_structure("n")).alias("sample"))


def even_sql(k, more):
    return f"WITH {PAGED_SQL} SELECT doc_id, n, CASE WHEN n > {more} THEN array_to_string([CAST(ceil(i::DOUBLE * n / (least({k}, n) + 1)) AS BIGINT) FOR i IN range(1, least({k}, n) + 1)], ',') ELSE '' END AS sample FROM paged"


@query("sample_pages_even", even_sql(5, 3))
def sample_pages_even(spark, d):
    return paged(spark, d).select("doc_id", "n", joined(sampling.evenly("n", 5, 3)).alias("sample"))


@query("sample_pages_even_full", even_sql(7, 4))
def sample_pages_even_full(spark, d):
    return paged(spark, d).select("doc_id", "n", joined(sampling.evenly("n", 7, 4)).alias("sample"))


@query(
    "sample_text_concat",
    f"WITH {PAGED_SQL} SELECT doc_id, md5(array_to_string([p || chr(10) || chr(10) FOR p IN list_concat(pages[1:5], CASE WHEN n > 10 THEN [pages[n // 2], pages[n]] ELSE [] END)], '')) AS sample_md5, md5(array_to_string(pages[1:5], chr(10) || chr(10))) AS light_md5, md5(array_to_string(pages[1:3], chr(10) || chr(10))) AS legacy_md5 FROM paged",
)
def sample_text_concat(spark, d):
    return paged(spark, d).select(
        "doc_id",
        F.md5(sampling.head_middle_tail_text("pages")).alias("sample_md5"),
        F.md5(sampling.head_text("pages", 5)).alias("light_md5"),
        F.md5(sampling.head_text("pages", 3)).alias("legacy_md5"),
    )


@query("context_tail", f"WITH {PAGES_SQL} SELECT doc_id, page, right(text, 800) AS tail_800, right(text, 500) AS tail_500, right(text, 300) AS tail_300, left(text, 3000) AS head_3000 FROM dpages")
def context_tail(spark, d):
    return pages(spark, d).select("doc_id", "page", *(sampling.tail("text", n).alias(f"tail_{n}") for n in (800, 500, 300)), F.left("text", F.lit(3000)).alias("head_3000"))


RUNS_SQL = f"""{LINES_SQL}, q AS (SELECT doc_id, line_no, (len(regexp_extract_all(line, '\\|')) >= 2) OR (len(regexp_extract_all(line, '\\t')) >= 2 AND len(regexp_extract_all(line, '\\d+')) >= 3) AS ok FROM dlines),
 isl AS (SELECT doc_id, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM q WHERE ok), runs AS (SELECT doc_id, g FROM isl GROUP BY doc_id, g HAVING count(*) >= 3)"""


@query("table_runs", f"WITH {RUNS_SQL} SELECT d.doc_id, CAST(count(r.g) AS BIGINT) AS table_runs FROM (SELECT DISTINCT doc_id FROM dlines) d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id")
def table_runs(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", T.table_runs("text").cast("long").alias("table_runs"))


@query("text_density", f"WITH {PAGED_SQL} SELECT doc_id, a AS avg_chars, CASE WHEN a < 500 THEN 'sparse' WHEN a > 2500 THEN 'dense' ELSE 'normal' END AS density FROM (SELECT doc_id, round(list_avg([length(pages[p]) FOR p IN {FML_SQL}]), 6) AS a FROM paged)")
def text_density(spark, d):
    sample = F.transform(sampling.picked("pages", sampling.first_middle_last("n")), lambda p: F.length(p))
    got = paged(spark, d).select("doc_id", F.round(F.aggregate(sample, F.lit(0), lambda a, x: a + x) / F.size(sample), 6).alias("avg_chars"))
    return got.withColumn("density", T.density("avg_chars"))


@query(
    "structure_depth",
    f"WITH {LINES_SQL} SELECT doc_id, CAST(least(6, greatest(1, max(greatest(len(regexp_extract_all(regexp_extract(line, '^((?:\\d+\\.)+)', 1), '\\d+')), length(regexp_extract(line, '^(#+)\\s', 1)))))) AS BIGINT) AS depth FROM dlines GROUP BY doc_id",
)
def structure_depth(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", T.structure_depth("text").cast("long").alias("depth"))


CODE_SQL = r"""(regexp_matches(text, '(?s)```.*?```') OR regexp_matches(text, 'function\s+\w+\s*\(') OR regexp_matches(text, 'def\s+\w+\s*\(') OR regexp_matches(text, 'class\s+\w+\s*[:{]') OR regexp_matches(text, 'import\s+.*from') OR regexp_matches(text, '(?i)</?[a-z][a-z0-9]*[^>]*>'))"""
MATH_SQL = r"""(regexp_matches(text, '\$.*\$') OR regexp_matches(text, '\\\[.*\\\]') OR regexp_matches(text, '\\frac\{') OR regexp_matches(text, '\\sum|\\int|\\prod') OR regexp_matches(text, '[∑∫∏∂∇]') OR regexp_matches(text, '[α-ωΑ-Ω]'))"""
NOTE_SQL = r"""(regexp_matches(text, '\[\d+\]') OR regexp_matches(text, '\(\d+\)') OR regexp_matches(text, '(?m)\d+\.\s+[A-Z].*\n') OR regexp_matches(text, '[¹²³⁴⁵⁶⁷⁸⁹⁰]+') OR regexp_matches(text, '\*{1,3}\s+\w') OR regexp_matches(text, '†|‡|§') OR regexp_matches(text, '(?m)^[\t\s]*\d+[.)]\s+.{10,}'))"""


@query("code_math_footnote_flags", f"SELECT doc_id, {CODE_SQL} AS has_code, {MATH_SQL} AS has_math, {NOTE_SQL} AS has_footnotes FROM documents WHERE text IS NOT NULL")
def code_math_footnote_flags(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", T.any_of("text", T.CODE).alias("has_code"), T.any_of("text", T.MATH).alias("has_math"), T.any_of("text", T.FOOTNOTE).alias("has_footnotes"))


@query("multi_column_flag", f"WITH {LINES_SQL} SELECT doc_id, count(*) > 5 AND sum(CASE WHEN regexp_matches(line, '\\s{{4,}}') THEN 1 ELSE 0 END)::DOUBLE / count(*) > 0.2 AS multi_column FROM dlines GROUP BY doc_id")
def multi_column_flag(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", T.multi_column("text").alias("multi_column"))


def presence_sql(text="text"):
    counts = {n: " + ".join(rf"CAST(regexp_matches(lower({text}), '\b{w}\b') AS INT)" for w in ws) for n, ws in T.PRESENCE}
    cols = ", ".join(f"{c} AS c{k}" for k, c in enumerate(counts.values()))
    top = "greatest(c0, c1, c2, c3, c4)"
    return cols, "CASE WHEN " + top + " < 3 THEN 'Unknown' " + " ".join(f"WHEN c{k} = {top} THEN '{n}'" for k, n in enumerate(counts)) + " END"


def frequency_sql(text="text"):
    counts = {n: " + ".join(rf"len(regexp_extract_all(left(lower({text}), 2000), '\b{w}\b'))" for w in ws) for n, ws in T.FREQUENCY}
    cols = ", ".join(f"{c} AS c{k}" for k, c in enumerate(counts.values()))
    top = "greatest(c0, c1, c2, c3, c4)"
    return cols, "CASE WHEN " + top + " < 1 THEN 'en' " + " ".join(f"WHEN c{k} = {top} THEN '{n}'" for k, n in enumerate(counts)) + " END"


PRESENCE_SQL = "SELECT doc_id, lang, {1} AS language FROM (SELECT doc_id, lang, {0} FROM documents WHERE text IS NOT NULL)".format(*presence_sql())


@query("language_presence", f"SELECT doc_id, language FROM ({PRESENCE_SQL})")
def language_presence(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", T.language_by_presence("text").alias("language"))


@query("language_frequency", "SELECT doc_id, {1} AS language FROM (SELECT doc_id, {0} FROM documents WHERE text IS NOT NULL)".format(*frequency_sql()))
def language_frequency(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", T.language_by_frequency("text").alias("language"))


@query("language_confusion", f"SELECT lang, language, CAST(count(*) AS BIGINT) AS documents FROM ({PRESENCE_SQL}) GROUP BY ALL")
def language_confusion(spark, d):
    got = corpus.table(spark, d, "documents").where("text IS NOT NULL").select("lang", T.language_by_presence("text").alias("language"))
    return got.groupBy("lang", "language").agg(F.count(F.lit(1)).cast("long").alias("documents"))


PLAIN_SQL = """regexp_matches(text, '[\\s.,!?;:''"()\\[\\]{}]')"""


@query("plain_text_or_base64", f"SELECT doc_id, {PLAIN_SQL} AS is_plain, md5(base64(encode(text))) AS encoded_md5, CASE WHEN {PLAIN_SQL} THEN FALSE ELSE TRUE END AS is_base64 FROM documents WHERE text IS NOT NULL")
def plain_text_or_base64(spark, d):
    plain = F.col("text").rlike(r"""[\s.,!?;:'"()\[\]{}]""")
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", plain.alias("is_plain"), F.md5(T.base64_text("text")).alias("encoded_md5"), (~plain).alias("is_base64"))


INCOMPLETE_SQL = """(length(rtrim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 AND NOT regexp_matches(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), '[.!?:;''"]$'))"""


@query("ends_incomplete", f"WITH {PAGES_SQL} SELECT doc_id, page, {INCOMPLETE_SQL} AS incomplete FROM dpages")
def ends_incomplete(spark, d):
    return pages(spark, d).select("doc_id", "page", T.ends_incomplete("text").alias("incomplete"))


# ------------------------------------------------------------------ complexity

FACTORS_SQL = f"""{PAGED_SQL}, s AS (SELECT doc_id, n, [pages[p] FOR p IN {FML_SQL}] AS sample FROM paged),
 e AS (SELECT doc_id, n, len(sample) AS k, unnest(sample) AS text, generate_subscripts(sample, 1) AS i FROM s),
 el AS (SELECT doc_id, i, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM e),
 q AS (SELECT doc_id, i, j, (len(regexp_extract_all(line, '\\|')) >= 2) OR (len(regexp_extract_all(line, '\\t')) >= 2 AND len(regexp_extract_all(line, '\\d+')) >= 3) AS ok FROM el),
 isl AS (SELECT doc_id, i, j - row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS g FROM q WHERE ok),
 runs AS (SELECT doc_id, count(*) AS r FROM (SELECT doc_id, i, g FROM isl GROUP BY ALL HAVING count(*) >= 3) GROUP BY doc_id),
 dep AS (SELECT doc_id, least(6, greatest(1, max(greatest(len(regexp_extract_all(regexp_extract(line, '^((?:\\d+\\.)+)', 1), '\\d+')), length(regexp_extract(line, '^(#+)\\s', 1)))))) AS depth FROM el GROUP BY doc_id),
 mc AS (SELECT doc_id, bool_or(m) AS multi FROM (SELECT doc_id, i, count(*) > 5 AND sum(CASE WHEN regexp_matches(line, '\\s{{4,}}') THEN 1 ELSE 0 END)::DOUBLE / count(*) > 0.2 AS m FROM el GROUP BY ALL) GROUP BY doc_id),
 f AS (SELECT doc_id, any_value(n) AS page_count, round(avg(length(text)), 6) AS avg_chars, bool_or({CODE_SQL}) AS has_code, bool_or({MATH_SQL}) AS has_math, bool_or({NOTE_SQL}) AS has_footnotes, any_value(k) AS k,
   CAST(round(sum(len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\('))) / any_value(k)::DOUBLE * any_value(n)) AS BIGINT) AS images FROM e GROUP BY doc_id),
 factors AS (SELECT f.doc_id, page_count, avg_chars, CASE WHEN avg_chars < 500 THEN 'sparse' WHEN avg_chars > 2500 THEN 'dense' ELSE 'normal' END AS density, has_code, has_math, has_footnotes, images, CAST(round(coalesce(r, 0)::DOUBLE / k) AS BIGINT) AS tables, CAST(depth AS BIGINT) AS depth, multi AS multi_column, FALSE AS has_toc
   FROM f JOIN dep USING (doc_id) JOIN mc USING (doc_id) LEFT JOIN runs USING (doc_id))"""
SCORE_SQL = """least(100, CASE WHEN page_count > 100 THEN 40 WHEN page_count > 50 THEN 30 WHEN page_count > 20 THEN 20 WHEN page_count > 5 THEN 10 ELSE 5 END + CASE WHEN has_toc THEN 10 ELSE 0 END + CASE WHEN depth > 4 THEN 10 WHEN depth > 2 THEN 5 ELSE 0 END
 + CASE WHEN images > 50 THEN 12 WHEN images > 20 THEN 8 WHEN images > 5 THEN 4 ELSE 0 END + CASE WHEN tables > 10 THEN 10 WHEN tables > 3 THEN 6 WHEN tables > 0 THEN 3 ELSE 0 END + CASE WHEN has_code THEN 4 ELSE 0 END + CASE WHEN has_math THEN 4 ELSE 0 END + CASE density WHEN 'dense' THEN 10 WHEN 'normal' THEN 5 ELSE 0 END)"""
TRIGGER_SQL = "(multi_column OR has_footnotes OR page_count > 20 OR (has_toc AND depth > 2) OR tables > 5 OR (images > 10 AND density = 'dense'))"
PLAN_SQL = f"""plan AS (SELECT *, CASE WHEN page_count <= 3 AND images <= 5 AND NOT has_toc THEN 'direct' WHEN {TRIGGER_SQL} THEN 'intelligent' WHEN has_toc AND score < 20 THEN 'light' WHEN score >= 60 THEN 'full' WHEN score >= 20 THEN 'light' ELSE 'direct' END AS pipeline,
  CASE WHEN page_count <= 3 AND images <= 5 AND NOT has_toc THEN 'simple' WHEN {TRIGGER_SQL} THEN CASE WHEN score >= 60 THEN 'complex' ELSE 'moderate' END WHEN has_toc AND score < 20 THEN 'moderate' WHEN score >= 60 THEN 'complex' WHEN score >= 20 THEN 'moderate' ELSE 'simple' END AS level FROM (SELECT *, CAST({SCORE_SQL} AS BIGINT) AS score FROM factors))"""


@query("complexity_factors", f"WITH {FACTORS_SQL} SELECT * FROM factors")
def complexity_factors(spark, d):
    return features.factors(paged(spark, d))


@query("complexity_plan", f"WITH {FACTORS_SQL}, {PLAN_SQL} SELECT doc_id, page_count, score, level, pipeline FROM plan")
def complexity_plan(spark, d):
    return features.planned(features.factors(paged(spark, d))).select("doc_id", "page_count", "score", "level", "pipeline")


@query(
    "plan_reasons",
    f"""WITH {FACTORS_SQL}, {PLAN_SQL} SELECT doc_id, pipeline, concat_ws('; ', CASE WHEN pipeline = 'intelligent' AND multi_column THEN 'multi-column layout' END, CASE WHEN pipeline = 'intelligent' AND has_footnotes THEN 'footnotes' END, CASE WHEN pipeline = 'intelligent' AND page_count > 20 THEN page_count || ' pages' END,
 CASE WHEN pipeline = 'intelligent' AND has_toc AND depth > 2 THEN 'nested contents' END, CASE WHEN pipeline = 'intelligent' AND tables > 5 THEN tables || ' tables' END, CASE WHEN pipeline = 'intelligent' AND images > 10 AND density = 'dense' THEN images || ' images in dense text' END,
 CASE WHEN pipeline = 'direct' AND page_count <= 3 THEN 'few pages' END, CASE WHEN pipeline <> 'intelligent' AND NOT (pipeline = 'direct' AND page_count <= 3) THEN 'score ' || score END) AS reasons FROM plan""",
)
def plan_reasons(spark, d):
    return features.planned(features.factors(paged(spark, d))).select("doc_id", "pipeline", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "time_estimate",
    f"WITH {FACTORS_SQL}, {PLAN_SQL} SELECT doc_id, pipeline, CAST(round(page_count * CASE pipeline WHEN 'direct' THEN 3 WHEN 'light' THEN 5 WHEN 'full' THEN 8 ELSE 10 END + 0.5::DOUBLE * images + 2 * tables + CASE WHEN pipeline <> 'direct' THEN 10 ELSE 0 END + CASE WHEN pipeline = 'full' THEN ceil(page_count / 50.0) * 5 ELSE 0 END) AS BIGINT) AS seconds FROM plan",
)
def time_estimate(spark, d):
    return features.planned(features.factors(paged(spark, d))).select("doc_id", "pipeline", "seconds")
