"""Layout profiles: zones, repeated lines, decorative images, coercion of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

ZONES = ("header_top", "header_bottom", "footer_top", "footer_bottom", "margin_left", "margin_right")
#: What a profile has where nothing is known (fixed values).
DEFAULTS = {"header_top": 0.0, "header_bottom": 10.0, "footer_top": 90.0, "footer_bottom": 100.0, "margin_left": 5.0, "margin_right": 95.0}
LIMITS = {"margin_left": (0.0, 50.0), "margin_right": (50.0, 100.0)}
FOOTNOTE_STYLES, COLUMN_LAYOUTS, IMAGE_ZONES = ("numbered", "symbolic", "none"), ("single", "double", "mixed"), ("header", "footer", "margin", "background")
SHARE = 0.4  #: of the pages that a pattern has to be on


def zone_medians(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(*(F.percentile(F.col(z), F.lit(0.5)).alias(z) for z in ZONES))


def most_common(rows: DataFrame, value: str, order: str, key: str = "doc_id") -> DataFrame:
    """(key, value): the most frequent value, of equal ones the one that comes first."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
    return best


def consensus(rows: DataFrame, value: str, other: str = "mixed", key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).otherwise(other).alias(value))


def repeated_lines(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """From (doc_id, pos, line): lines that recur, apart from numbers and white space, in a share of the rows, as first seen."""
    known = lines.where(F.col("line").isNotNull()).withColumn("norm", T.normalized_line("line"))
    counted = known.groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "line")).alias("first"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    least = F.greatest(F.lit(1), F.floor(total * F.lit(share)))
    return counted.withColumn("least", least).where("n >= least").select("doc_id", "norm", F.col("first.line").alias("line"), F.col("first.pos").alias("pos"), F.col("n").cast("long").alias("n"))


def common_line(lines: Column) -> Column:
    """Of an array of lines: the first one that half of them equal and that is longer than two characters; ``\\d+`` if all
    are numbers; else, or for fewer than three lines, null."""

    def often(ordered):
        # A line that makes up half of them stands in the middle of the sorted lines, or right before it.
        n = F.size(ordered)
        middle = F.array_distinct(F.array(F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))))
        enough = F.filter(middle, lambda x: (F.size(F.filter(ordered, lambda y: y == x)) >= n * 0.5) & (F.length(x) > 2))
        return T.let(enough, lambda e: F.get(F.filter(lines, lambda x: F.array_contains(e, x)), F.lit(0)))

    return F.when(F.size(lines) >= 3, F.coalesce(T.let(F.array_sort(lines), often), F.when(F.forall(lines, lambda x: x.rlike(r"^\d+$")), F.lit(r"\d+"))))


def edge_lines(text) -> Column:
    """struct<first,last> of the trimmed non-blank lines of a page; a last one only if there are two."""
    ls = F.filter(F.transform(T.lines(text), T.trimmed), lambda x: x != "")
    return F.struct(F.get(ls, F.lit(0)).alias("first"), F.when(F.size(ls) >= 2, F.get(ls, F.size(ls) - 1)).alias("last"))


def page_number_pattern(patterns) -> Column:
    """A regex for page numbers from examples (array); dashes win, then page and of, then page."""
    p = T.col(patterns)
    has = lambda rx: F.exists(p, lambda x: x.rlike(rx))
    return (
        F.when(F.size(p) == 0, r"^\s*(?:Page\s+)?\d+(?:\s+of\s+\d+)?\s*$")
        .when(has(r"-\s*\d+\s*-"), r"^\s*-\s*\d+\s*-\s*$")
        .when(has("(?i)page") & has("(?i)of"), r"^\s*Page\s+\d+\s+of\s+\d+\s*$")
        .when(has("(?i)page"), r"^\s*Page\s+\d+\s*$")
        .otherwise(r"^\s*\d+\s*$")
    )


def decorative(description, kind, x, y, page, patterns, positions, zones) -> Column:
    """Whether an image is decorative. positions: array<struct<page,zone>>; x, y in thousandths; zones: struct of percentages."""
    named = F.exists(patterns, lambda p: F.contains(F.lower(description), F.lower(p)))
    px, py = x / 10, y / 10
    placed = F.exists(
        positions,
        lambda q: (q["page"] == page)
        & (
            ((q["zone"] == "header") & (py < zones["header_bottom"]))
            | ((q["zone"] == "footer") & (py > zones["footer_top"]))
            | ((q["zone"] == "margin") & ((px < zones["margin_left"]) | (px > zones["margin_right"])))
        ),
    )
    return named | placed | kind.isin("logo", "icon")


ANSWER = "struct<headerZone:struct<top:double,bottom:double>,footerZone:struct<top:double,bottom:double>,marginZones:struct<left:double,right:double>,headerText:string,footerText:string,footnoteStyle:string,columnLayout:string,pageNumberPattern:string,decorativeImages:array<struct<zone:string,description:string>>>"


def coerced(answer) -> list[Column]:
    """Columns of a model's layout answer: the JSON between the outer braces, clamped, with defaults."""
    j = F.from_json(F.regexp_extract(T.col(answer), r"(?s)\{.*\}", 0), ANSWER)
    got = dict(zip(ZONES, (j["headerZone"]["top"], j["headerZone"]["bottom"], j["footerZone"]["top"], j["footerZone"]["bottom"], j["marginZones"]["left"], j["marginZones"]["right"]), strict=True))
    out = []
    for z, v in got.items():
        low, high = LIMITS.get(z, (0.0, 100.0))
        out.append(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(v, F.lit(DEFAULTS[z])))).alias(z))
    style, columns = j["footnoteStyle"], j["columnLayout"]
    out.append(F.when(style.isin(*FOOTNOTE_STYLES), style).otherwise("none").alias("footnote_style"))
    out.append(F.when(columns.isin(*COLUMN_LAYOUTS), columns).otherwise("single").alias("column_layout"))
    return out


def page_profile(answer) -> Column:
    """A page's layout as a struct, from a model's answer."""
    j = F.from_json(F.regexp_extract(T.col(answer), r"(?s)\{.*\}", 0), ANSWER)
    zone = lambda z: F.when(z.isin(*IMAGE_ZONES), z).otherwise("background")
    images = F.transform(F.filter(F.coalesce(j["decorativeImages"], F.array().cast("array<struct<zone:string,description:string>>")), lambda x: x.isNotNull()), lambda x: F.struct(zone(x["zone"]).alias("zone"), F.coalesce(x["description"], F.lit("")).alias("description")))
    return F.struct(*coerced(answer), j["headerText"].alias("header_text"), j["footerText"].alias("footer_text"), j["pageNumberPattern"].alias("number_pattern"), images.alias("images"))


def is_default(page: Column) -> Column:
    """Whether a page's layout says nothing beyond the defaults."""
    empty = page["header_text"].isNull() & page["footer_text"].isNull() & page["number_pattern"].isNull() & (F.size(page["images"]) == 0)
    return empty & (page["header_bottom"] == DEFAULTS["header_bottom"]) & (page["footer_top"] == DEFAULTS["footer_top"])


def repeated_texts(texts: Column) -> Column:
    """Of an array of texts: those that recur in a share of them apart from numbers and white space, each as first seen."""

    def of(known):
        least = F.greatest(F.lit(1), F.floor(F.size(known) * F.lit(SHARE)))
        same = lambda norm, i: F.size(F.filter(norm, lambda y: y == F.get(norm, i)))
        return T.let(F.transform(known, T.normalized_line), lambda norm: F.filter(known, lambda x, i: (F.array_position(norm, F.get(norm, i)) == i + 1) & (same(norm, i) >= least)))

    return T.let(F.filter(texts, lambda x: x.isNotNull()), of)


def most_common_of(values: Column) -> Column:
    """The most frequent value of an array, of equal ones the first."""

    def of(distinct):
        counts = F.transform(distinct, lambda x: F.size(F.filter(values, lambda y: y == x)))
        return T.let(counts, lambda c: F.get(distinct, (F.array_position(c, F.array_max(c)) - 1).cast("int")))

    return T.let(F.array_distinct(values), of)


def median_of(values: Column) -> Column:
    return T.let(F.array_sort(values), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


def document_profile(sampled: Column) -> Column:
    """A document's layout from array<struct<page,a>> of sampled pages' profiles: medians, modes, repeated texts, decorative images."""
    each = lambda name: F.transform(sampled, lambda s: s["a"][name])
    images = F.flatten(F.transform(sampled, lambda s: F.transform(s["a"]["images"], lambda x: F.struct(s["page"].alias("page"), x["zone"].alias("zone"), x["description"].alias("description")))))
    least = F.greatest(F.lit(1), F.floor(F.size(sampled) * F.lit(SHARE)))
    patterns = T.let(F.transform(images, lambda x: F.concat_ws(" ", x["description"], x["zone"])), lambda t: F.filter(F.array_distinct(t), lambda x: F.size(F.filter(t, lambda y: y == x)) >= least))
    columns = F.array_distinct(each("column_layout"))
    return F.struct(
        *(median_of(each(z)).alias(z) for z in ZONES),
        most_common_of(each("footnote_style")).alias("footnote_style"),
        F.when(F.size(columns) == 1, F.get(columns, F.lit(0))).otherwise("mixed").alias("column_layout"),
        repeated_texts(each("header_text")).alias("headers"),
        repeated_texts(each("footer_text")).alias("footers"),
        T.let(F.filter(each("number_pattern"), lambda x: x.isNotNull()), page_number_pattern).alias("page_numbers"),
        patterns.alias("decorative"),
        F.transform(images, lambda x: F.struct(x["page"].alias("page"), x["zone"].alias("zone"))).alias("positions"),
    )


def profiles(pages: DataFrame) -> DataFrame:
    """One layout profile for each document of page rows (doc_id, page, zones, footnote_style, column_layout)."""
    style = most_common(pages, "footnote_style", "page")
    columns = consensus(pages, "column_layout")
    return zone_medians(pages).join(style, "doc_id").join(columns, "doc_id")
