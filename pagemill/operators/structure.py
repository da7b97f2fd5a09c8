"""Coercion of model answers about structure, response parsing, errors, costs and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.text import col

TYPES = ("academic", "book", "report", "marketing", "manual", "legal", "other")  # fixed values
NOTE_STYLES = ("inline", "endnote", "chapter-end")
ENTRY = "struct<level:double,title:string,page:double,children:string>"  # children: JSON as it stands
ANSWER = f"struct<documentType:string,toc:struct<explicit:boolean,entries:array<{ENTRY}>>,hierarchy:struct<maxDepth:double>,sections:struct<frontMatter:struct<start:double,end:double>,body:struct<start:double,end:double>,backMatter:struct<start:double,end:double>>,crossReferences:struct<footnoteStyle:string,citationStyle:string>>"


def clamp(x, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def validated(answer, n) -> list[Column]:
    """Columns of a structure profile from the JSON between the outer braces of an answer; defaults where it has none."""
    j = F.from_json(F.regexp_extract(col(answer), r"(?s)\{.*\}", 0), ANSWER)
    n = col(n).cast("double")

    def span(r):
        start = clamp(r["start"], 1, n)
        return F.when(r["start"].isNotNull() & r["end"].isNotNull(), F.struct(start.alias("start"), F.greatest(start, F.least(n, r["end"])).alias("end")))

    front, back, body = span(j["sections"]["frontMatter"]), span(j["sections"]["backMatter"]), j["sections"]["body"]
    start = F.when(body["start"].isNotNull(), F.greatest(F.lit(1.0), body["start"])).otherwise(F.coalesce(front["end"] + 1, F.lit(1.0)))
    end = F.when(body["end"].isNotNull(), F.least(n, body["end"])).otherwise(F.coalesce(back["start"] - 1, n))
    empty = end < start
    entries = F.transform(contents(j["toc"]["entries"], n, braces(answer)), lambda e: F.concat_ws(":", e["level"].cast("string"), e["page"].cast("string"), e["title"]))
    notes = j["crossReferences"]["footnoteStyle"]
    return [
        F.when(j["documentType"].isin(*TYPES), j["documentType"]).otherwise("other").alias("document_type"),
        F.array_join(entries, "|").alias("toc"),
        F.coalesce(clamp(j["hierarchy"]["maxDepth"], 1, 6), F.lit(2.0)).cast("long").alias("max_depth"),
        F.when(empty, 1.0).otherwise(start).cast("long").alias("body_start"),
        F.when(empty, n).otherwise(end).cast("long").alias("body_end"),
        F.when(notes.isin(*NOTE_STYLES), notes).otherwise("inline").alias("footnote_style"),
        F.nullif(j["crossReferences"]["citationStyle"], F.lit("")).alias("citation_style"),
    ]


def braces(answer) -> Column:
    """The number of opening braces of a text: no fewer than it has nested entries."""
    return F.length(col(answer)) - F.length(F.replace(col(answer), F.lit("{"), F.lit("")))


def contents(entries, n, most) -> Column:
    """Nested contents entries, however deep, as array<struct<level,title,page,depth>> in pre-order; an entry without a level is one below its parent.

    A list of what is to come is worked off from the front, an entry's children taking its
    place; there are at most ``most`` entries.
    """
    item, kind = f"array<struct<e:{ENTRY},depth:int,level:int>>", "array<struct<level:int,title:string,page:bigint,depth:int>>"
    items = lambda es, depth, level: F.transform(F.filter(es, lambda e: e.isNotNull()), lambda e: F.struct(e.alias("e"), depth.cast("int").alias("depth"), level.cast("int").alias("level")))
    none = lambda k: F.array().cast(k)

    def step(acc, _):
        todo, out = acc["todo"], acc["out"]
        head = F.get(todo, F.lit(0))
        e = head["e"]
        level = F.coalesce(clamp(e["level"], 1, 6), (F.coalesce(head["level"], F.lit(0)) + 1).cast("double")).cast("int")
        here = F.array(F.struct(level.alias("level"), F.coalesce(e["title"], F.lit("Untitled")).alias("title"), F.coalesce(clamp(e["page"], 1, n), F.lit(1.0)).cast("long").alias("page"), head["depth"].alias("depth"))).cast(kind)
        below = items(F.from_json(e["children"], f"array<{ENTRY}>"), head["depth"] + 1, level)
        rest = F.slice(todo, F.lit(2), F.size(todo))
        more = F.struct(F.concat(F.coalesce(below.cast(item), none(item)), rest).alias("todo"), F.concat(out, here).alias("out"))
        return F.when(F.size(todo) > 0, more).otherwise(acc)

    start = F.struct(F.coalesce(items(entries, F.lit(0), F.lit(None)).cast(item), none(item)).alias("todo"), none(kind).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.coalesce(most, F.lit(0))), start, step)["out"]


def profile(answer, n) -> Column:
    """A document's structure as a struct: document_type, max_depth, explicit and toc (see contents)."""
    j = F.from_json(F.regexp_extract(col(answer), r"(?s)\{.*\}", 0), ANSWER)
    return F.struct(
        F.when(j["documentType"].isin(*TYPES), j["documentType"]).otherwise("other").alias("document_type"),
        F.coalesce(clamp(j["hierarchy"]["maxDepth"], 1, 6), F.lit(2.0)).cast("int").alias("max_depth"),
        F.coalesce(j["toc"]["explicit"], F.lit(False)).alias("explicit"),
        contents(j["toc"]["entries"], col(n).cast("double"), braces(answer)).alias("toc"),
    )


def parsed_response(text) -> list[Column]:
    """content, summary and last_paragraph of a marked response; without a content mark the whole text is content."""
    t = col(text)
    marked = t.rlike(r"(?i)\[CONTENT\]")
    return [
        F.when(marked, T.trimmed(F.regexp_extract(t, r"(?si)\[CONTENT\](.*?)(?:\[IMAGES\]|\[SUMMARY\]|$)", 1))).otherwise(t).alias("content"),
        T.trimmed(F.regexp_extract(t, r"(?si)\[SUMMARY\](.*?)(?:\[LAST_PARAGRAPH\]|$)", 1)).alias("summary"),
        T.trimmed(F.regexp_extract(t, r"(?si)\[LAST_PARAGRAPH\](.*)$", 1)).alias("last_paragraph"),
    ]


def parsed_legacy(text) -> list[Column]:
    """content and images (map of bbox arrays) of the earlier marks; without a content mark the whole text is content."""
    t = col(text)
    content = F.when(t.rlike(r"(?i)\[CONTENT\]"), T.trimmed(F.regexp_extract(t, r"(?si)\[CONTENT\](.*?)(?:\[COORDINATES\]|$)", 1))).otherwise(t)
    return [content.alias("content"), F.from_json(F.regexp_extract(t, r"(?si)\[COORDINATES\]\s*```json(.*?)```", 1), "map<string,array<double>>").alias("images")]


IMAGES = "map<string,struct<bbox:array<double>,description:string>>"
PLACED = "map<string,struct<bbox:array<double>,description:string,type:string>>"


def parsed_images(text) -> Column:
    """map<id,struct<bbox,description,type>> of the fenced JSON after [IMAGES]; broken JSON gives none."""
    j = F.from_json(F.regexp_extract(col(text), r"(?si)\[IMAGES\]\s*```json(.*?)```", 1), IMAGES)
    whole = F.array(*(F.lit(v) for v in (0.0, 0.0, 1000.0, 1000.0)))
    return F.transform_values(j, lambda k, v: F.struct(F.coalesce(v["bbox"], whole).alias("bbox"), F.coalesce(F.nullif(v["description"], F.lit("")), F.lit("Image")).alias("description"), F.lit("other").alias("type")))


def placeholders_filled(text, crops, empty_too: bool = True) -> Column:
    """Placeholders replaced by their crop (map id to URL), in the map's order; those left over become a note."""
    return placeholders_noted(F.aggregate(F.map_entries(col(crops)), col(text), lambda s, e: F.replace(s, e["key"], e["value"])), empty_too)


def placeholders_noted(text, empty_too: bool = False) -> Column:
    """Placeholders, and empty links if wanted, as a note."""
    t = F.regexp_replace(col(text), r"!\[(.*?)\]\((img_placeholder_[a-zA-Z0-9_]+)\)", "> *[Image: $1]*")
    t = F.regexp_replace(t, r"!\[(.*?)\]\(\s*\)", "> *[Image: $1]*") if empty_too else t
    return F.when(F.contains(col(text), F.lit("![")), t).otherwise(col(text))


def images_resolved(text, images) -> Column:
    """``{{image:id}}`` and ``[image:id]`` become Markdown images (map id to struct<description,url,decorative>); unknown
    and decorative ones vanish."""
    t, rx = col(text), r"\{\{image:([^}]+)\}\}|\[image:([^\]]+)\]"
    gaps = F.split(t, rx)
    ids = F.regexp_extract_all(t, F.lit(rx), F.lit(0))

    def link(mark):
        i = F.regexp_replace(mark, r"^\{\{image:|^\[image:|\}\}$|\]$", "")
        im = F.element_at(col(images), i)
        return F.when(im.isNull() | im["decorative"], "").otherwise(F.concat(F.lit("!["), F.coalesce(F.nullif(im["description"], F.lit("")), F.concat(F.lit("Image "), i)), F.lit("]("), im["url"], F.lit(")")))

    return F.array_join(F.zip_with(gaps, F.transform(ids, link), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def placeholders_told(text) -> Column:
    """The earlier wording for placeholders and empty links that are left over."""
    t = F.regexp_replace(col(text), r"!\[(.*?)\]\((img_placeholder_[a-zA-Z0-9_]+)\)", "> *[Image extraction failed or coordinates missing for: $1]*")
    return F.regexp_replace(t, r"!\[(.*?)\]\(\s*\)", "> *[Image missing: $1]*")


def error_class(message) -> list[Column]:
    """kind, status and retryable of an error's message."""
    m = F.lower(col(message))
    status = F.nullif(F.regexp_extract(m, r"status[:\s]*(\d{3})", 1), F.lit("")).cast("long")
    has = lambda s: F.contains(m, F.lit(s))
    limit, late = has("rate limit") | has("429"), has("timeout")
    soft = has("503") | has("econnreset") | has("network")
    kind = F.when(limit, "rate_limit").when(late, "timeout").otherwise("api")
    shown = F.when(kind == "api", status)
    retry = F.when(kind == "rate_limit", True).when(kind == "timeout", True).when(shown.isNotNull(), (shown == 429) | (shown >= 500)).otherwise(soft)
    return [kind.alias("kind"), shown.alias("status"), retry.alias("retryable")]


#: Tokens of a page (base, by complexity) and prices of a million, in and out (fixed values).
PRICES = {"vision": ((2000, 1000, 3.0), (1000, 500, 15.0)), "flash": ((1500, 500, 0.075), (500, 300, 0.30))}


def cost(pages, complexity, provider: str) -> Column:
    return sum(((col(pages) * (F.lit(base) + col(complexity) * more)) / 1_000_000 * F.lit(price) for base, more, price in PRICES[provider]), F.lit(0.0))


def route(has_vision, has_flash, pages, copyrighted, native) -> Column:
    v, f, n = col(has_vision), col(has_flash), col(pages)
    return (
        F.when(~v & ~f, F.lit(None).cast("string"))
        .when(v & ~f, "vision")
        .when(~v & f, "flash")
        .when(col(copyrighted), "vision")
        .when(col(native) & (n <= 100), "vision")
        .when(n > 100, "flash")
        .otherwise("vision")
    )
