"""Complexity factors, score, plan and estimates of documents.

Everything about a document comes from the array of its pages, so that the whole
chain is one narrow projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import sampling

MODERATE, COMPLEX = 20, 60
#: Seconds a page by plan (fixed values).
PAGE_SECONDS = {"direct": 3, "light": 5, "full": 8, "intelligent": 10}


def _whole(x) -> Column:
    """Rounded half up, as a long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def factors(paged: DataFrame, k: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """From (doc_id, n, pages): one row of factors for each document, from a sample of k pages; keep: columns to keep."""
    s = paged.withColumn("sample", sampling.picked("pages", sampling.first_middle_last("n", k)))
    each = F.transform(
        "sample",
        lambda t: F.struct(
            F.length(t).alias("chars"),
            T.table_runs(t).alias("runs"),
            T.structure_depth(t).alias("depth"),
            T.multi_column(t).alias("multi"),
            T.any_of(t, T.CODE).alias("code"),
            T.any_of(t, T.MATH).alias("math"),
            T.any_of(t, T.FOOTNOTE).alias("notes"),
            F.regexp_count(t, F.lit(r"!\[[^\]]*\]\(")).alias("images"),
        ),
    )
    s = s.withColumn("each", each)
    total = lambda name: F.aggregate("each", F.lit(0), lambda a, x: a + x[name])
    some = lambda name: F.exists("each", lambda x: x[name])
    size = F.size("each")
    out = s.select(
        "doc_id",
        *keep,
        F.col("n").alias("page_count"),
        F.round(total("chars") / size, 6).alias("avg_chars"),
        some("code").alias("has_code"),
        some("math").alias("has_math"),
        some("notes").alias("has_footnotes"),
        _whole(total("images") / size * F.col("n")).alias("images"),
        _whole(total("runs") / size).alias("tables"),
        F.array_max(F.transform("each", lambda x: x["depth"])).cast("long").alias("depth"),
        some("multi").alias("multi_column"),
        F.lit(False).alias("has_toc"),
    )
    return out.withColumn("density", T.density("avg_chars"))


def _steps(value: str, *steps: tuple[int, int], otherwise: int = 0) -> Column:
    out = F.lit(otherwise)
    for over, points in reversed(steps):
        out = F.when(F.col(value) > over, points).otherwise(out)
    return out


def score() -> Column:
    points = (
        _steps("page_count", (100, 40), (50, 30), (20, 20), (5, 10), otherwise=5)
        + F.when(F.col("has_toc"), 10).otherwise(0)
        + _steps("depth", (4, 10), (2, 5))
        + _steps("images", (50, 12), (20, 8), (5, 4))
        + _steps("tables", (10, 10), (3, 6), (0, 3))
        + F.when(F.col("has_code"), 4).otherwise(0)
        + F.when(F.col("has_math"), 4).otherwise(0)
        + F.when(F.col("density") == "dense", 10).when(F.col("density") == "normal", 5).otherwise(0)
    )
    return F.least(F.lit(100), points).cast("long")


def planned(f: DataFrame, moderate: int = MODERATE, complex_: int = COMPLEX, force: str | None = None) -> DataFrame:
    """f with score, pipeline, level, reasons and seconds."""
    c = F.col
    triggers = [
        (c("multi_column"), F.lit("multi-column layout")),
        (c("has_footnotes"), F.lit("footnotes")),
        (c("page_count") > 20, F.concat(c("page_count").cast("string"), F.lit(" pages"))),
        (c("has_toc") & (c("depth") > 2), F.lit("nested contents")),
        (c("tables") > 5, F.concat(c("tables").cast("string"), F.lit(" tables"))),
        ((c("images") > 10) & (c("density") == "dense"), F.concat(c("images").cast("string"), F.lit(" images in dense text"))),
    ]
    any_trigger = F.lit(False)
    for fires, _ in triggers:
        any_trigger = any_trigger | fires
    small = (c("page_count") <= 3) & (c("images") <= 5) & ~c("has_toc")
    plan = F.when(small, "direct").when(any_trigger, "intelligent").when(c("has_toc") & (c("score") < moderate), "light").when(c("score") >= complex_, "full").when(c("score") >= moderate, "light").otherwise("direct")
    level = (
        F.when(small, "simple")
        .when(any_trigger, F.when(c("score") >= complex_, "complex").otherwise("moderate"))
        .when(c("has_toc") & (c("score") < moderate), "moderate")
        .when(c("score") >= complex_, "complex")
        .when(c("score") >= moderate, "moderate")
        .otherwise("simple")
    )
    out = f.withColumn("score", score()).withColumn("level", level).withColumn("pipeline", F.lit(force) if force else plan)
    few = (c("pipeline") == "direct") & (c("page_count") <= 3)
    reasons = F.array(
        *(F.when((c("pipeline") == "intelligent") & fires, told) for fires, told in triggers),
        F.when(few, F.lit("few pages")),
        F.when((c("pipeline") != "intelligent") & ~few, F.concat(F.lit("score "), c("score").cast("string"))),
    )
    a_page = F.lit(None).cast("int")
    for name, s in PAGE_SECONDS.items():
        a_page = F.when(c("pipeline") == name, s).otherwise(a_page)
    seconds = c("page_count") * a_page + 0.5 * c("images") + 2 * c("tables") + F.when(c("pipeline") != "direct", 10).otherwise(0) + F.when(c("pipeline") == "full", F.ceil(c("page_count") / 50) * 5).otherwise(0)
    return out.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).withColumn("seconds", _whole(seconds))
