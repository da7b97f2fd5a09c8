"""Sections, footnotes and their organisation into one Markdown document.

A document is the array of its page texts; parsing, footnote splitting, heading
repair, continuation merging and rendering are array expressions over it, so that
a whole corpus is organised in one narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.text import col

HEADING = r"^(#{1,6})\s+(.+)$"
NOTES = {"numbered": r"(?m)^(\d+)\.\s+(.+)$", "symbolic": "(?m)^([*†‡§])\\s+(.+)$"}
#: Where footnotes go by document type (fixed values); others are inline.
PLACEMENT = {"academic": "document-end", "book": "section-end", "report": "section-end", "manual": "section-end"}


def parse(text, max_depth=6) -> Column:
    """array<struct<n,level,title,content>> of a page: text before the first heading is a section of level 0; an
    empty last section is dropped; levels are max_depth (a number or a column) at most."""
    most = max_depth if isinstance(max_depth, Column) else F.lit(max_depth)

    def of_lines(ls):
        is_heading = lambda i: F.get(ls, i).rlike(HEADING)
        begins = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | is_heading(i))

        def section(begins, i, k):
            here, end = F.get(ls, i), F.coalesce(F.get(begins, k + 1), F.size(ls))
            head = is_heading(i)
            skip = head.cast("int")
            return F.struct(
                (k + 1).cast("int").alias("n"),
                F.when(head, F.least(F.length(F.regexp_extract(here, HEADING, 1)), most)).otherwise(0).alias("level"),
                F.when(head, T.trimmed(F.regexp_extract(here, HEADING, 2))).otherwise("").alias("title"),
                T.trimmed(F.array_join(F.slice(ls, i + 1 + skip, end - i - skip), "\n")).alias("content"),
            )

        found = T.let(begins, lambda b: F.transform(b, lambda i, k: section(b, i, k)))
        return T.let(found, lambda f: F.filter(f, lambda s, k: (k < F.size(f) - 1) | (s["content"] != "") | (s["title"] != "")))

    return T.let(T.lines(text), of_lines)


def footnotes(text, style: str = "numbered") -> Column:
    """array<struct<id,content>> of a page's definitions, the first one of an id."""
    kind = "array<struct<id:string,content:string>>"
    if style not in NOTES:
        return F.array().cast(kind)
    p = F.lit(NOTES[style])
    all_ = F.zip_with(F.regexp_extract_all(col(text), p, F.lit(1)), F.regexp_extract_all(col(text), p, F.lit(2)), lambda i, c: F.struct(i.alias("id"), T.trimmed(c).alias("content")))
    return T.let(all_, lambda a: F.filter(a, lambda x, k: F.array_position(F.transform(a, lambda y: y["id"]), x["id"]) == k + 1))


def without_footnotes(text, style: str = "numbered") -> Column:
    if style not in NOTES:
        return col(text)
    return T.trimmed(F.regexp_replace(F.regexp_replace(col(text), NOTES[style], ""), r"\n{3,}", "\n\n"))


def by_style(style, f, otherwise) -> Column:
    """f(style) for the style that a column holds."""
    out = otherwise
    for name in NOTES:
        out = F.when(col(style) == name, f(name)).otherwise(out)
    return out


def references(content, notes) -> Column:
    """Ids of the page's notes that a content marks as ``[id]``."""
    return F.transform(F.filter(col(notes), lambda x: F.contains(content, F.concat(F.lit("["), x["id"], F.lit("]")))), lambda x: x["id"])


def strip_repeated(text, patterns: list[str], number_pattern: str | None = None) -> Column:
    """Without lines that equal a header or footer, or match the page number's pattern."""
    t = col(text)
    for p in patterns:
        t = F.regexp_replace(t, r"(?m)^\s*" + _quoted(p) + r"\s*$", "")
    if number_pattern:
        t = F.regexp_replace(t, "(?m)" + number_pattern, "")
    return T.trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def without_repeated(text, patterns, number_pattern) -> Column:
    """As strip_repeated, with the lines (an array) and the number's pattern in columns."""
    line = lambda t, p: F.when(F.contains(t, p), F.regexp_replace(t, F.concat(F.lit(r"(?m)^\s*"), T.escaped_regex(p), F.lit(r"\s*$")), F.lit(""))).otherwise(t)
    t = F.aggregate(patterns, col(text), line)
    t = F.regexp_replace(t, F.concat(F.lit("(?m)"), number_pattern), F.lit(""))
    return T.trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in s)


def repaired_levels(levels) -> Column:
    """Heading levels without jumps: a first heading deeper than 2 becomes 1, a deeper jump the next level; 0 stays."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        fixed = F.when(x == 0, 0).when(acc["last"] == 0, F.when(x > 2, 1).otherwise(x)).when(x > acc["last"] + 1, acc["last"] + 1).otherwise(x)
        return F.struct(F.when(x == 0, acc["last"]).otherwise(fixed).cast("int").alias("last"), F.concat(acc["out"], F.array(fixed.cast("int"))).alias("out"))

    return F.aggregate(levels, start, step)["out"]


def merged(sections, lists: tuple[str, ...] = ()) -> Column:
    """Continuations joined into the section they continue, all the way down, in depth-first order.

    sections: array<struct<id,level,title,content,continues_from,...>>, a continued section before its
    continuations; a link to no earlier section keeps the section as it is.  lists: fields with arrays, whose
    distinct members are joined.  Finding a parent walks the sections before it, so the work grows with the square of a
    document's sections; a document is one row, and no two documents meet.
    """
    walked = F.aggregate(
        sections,
        F.array().cast("array<struct<id:string,root:string,path:string>>"),
        lambda acc, s: F.concat(
            acc,
            F.transform(
                F.array(F.get(F.filter(acc, lambda a: a["id"] == s["continues_from"]), F.lit(0))),
                lambda parent: F.struct(
                    s["id"].alias("id"),
                    F.coalesce(parent["root"], s["id"]).alias("root"),
                    F.concat(F.coalesce(F.concat(parent["path"], F.lit("/")), F.lit("")), F.lpad(F.size(acc).cast("string"), 6, "0")).alias("path"),
                ),
            ),
        ),
    )
    placed = F.zip_with(sections, walked, lambda s, w: F.struct(w["root"].alias("root"), w["path"].alias("path"), s["content"].alias("content"), s["id"].alias("id"), s["level"].alias("level"), s["title"].alias("title"), *(s[x].alias(x) for x in lists)))

    def field(array, name):
        return F.transform(array, lambda y: y[name])

    def joined(placed):
        chain = lambda r: F.array_sort(F.transform(F.filter(placed, lambda s: s["root"] == r["id"]), lambda s: F.struct(s["path"].alias("path"), s["content"].alias("content"), *(s[x].alias(x) for x in lists))))
        return F.transform(
            F.filter(placed, lambda s: s["root"] == s["id"]),
            lambda r: T.let(chain(r), lambda c: F.struct(r["id"].alias("id"), r["level"].alias("level"), r["title"].alias("title"), F.array_join(F.transform(c, lambda x: x["content"]), "\n\n").alias("content"), F.size(c).alias("parts"), *(F.array_distinct(F.flatten(field(c, x))).alias(x) for x in lists))),
        )

    return T.let(placed, joined)


def rendered(level, title, content, then=lambda c: c) -> Column:
    """A section as Markdown: heading and blank line if it has both title and level, then then(its content with marked footnotes)."""
    level, title, content = col(level), col(title), then(T.footnote_markers(content))
    head = F.when((title != "") & (level > 0), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title, F.lit("\n")))
    body = F.when(T.trimmed(content) != "", content)
    return F.array_join(F.array_compact(F.array(head, body)), "\n")


def assembled(sections, toc=None) -> Column:
    """Rendered sections, repaired and cleaned, as one Markdown text."""
    parts = T.let(sections, lambda ss: F.zip_with(ss, repaired_levels(F.transform(ss, lambda s: s["level"])), lambda s, level: rendered(level, s["title"], s["content"])))
    body = F.array_join(F.transform(F.filter(parts, lambda p: T.trimmed(p) != ""), lambda p: F.concat(p, F.lit("\n"))), "\n")
    return T.cleaned_markdown(F.concat(F.coalesce(F.concat(toc, F.lit("\n")), F.lit("")), body) if toc is not None else body)


def toc(entries, max_level: int = 3) -> Column:
    """Contents list of array<struct<level,title,depth>> in pre-order; an entry deeper than max_level goes with all below it."""
    line = lambda e: F.concat(F.repeat(F.lit("  "), e["depth"]), F.lit("- ["), e["title"], F.lit("](#"), T.slug(e["title"]), F.lit(")"))

    def step(acc, e):  # cut: the depth of an entry that is left out, whose children go, too
        gone, deep = e["depth"] > acc["cut"], e["level"] > max_level
        return F.struct(F.when(gone, acc["cut"]).when(deep, e["depth"]).otherwise(F.lit(99)).cast("int").alias("cut"), F.when(gone | deep, acc["out"]).otherwise(F.concat(acc["out"], F.array(line(e)))).alias("out"))

    lines = F.aggregate(entries, F.struct(F.lit(99).alias("cut"), F.array().cast("array<string>").alias("out")), step)["out"]
    return F.concat(F.lit("## Table of Contents\n\n"), F.array_join(lines, "\n"), F.lit("\n"))


def placement(document_type) -> Column:
    out = F.lit("inline")
    for kind, where in PLACEMENT.items():
        out = F.when(col(document_type) == kind, where).otherwise(out)
    return out


def without_edges(text, header, footer) -> Column:
    """A text without what stands at the begin of a line like the header, or at the end of one like the footer; null: none."""

    def gone(t, edge, before, after):
        hit = edge.isNotNull() & F.contains(t, edge)
        return F.when(hit, F.regexp_replace(t, F.concat(F.lit(before), T.escaped_regex(edge), F.lit(after)), F.lit(""))).otherwise(t)

    return T.let(gone(col(text), header, "(?m)^", r"\s*\n?"), lambda t: gone(t, footer, r"(?m)\n?", r"\s*$"))


def _run_on(parts, tail, header, footer) -> Column:
    """parts joined by blank lines; one whose tail(part) is open, where the next goes on, keeps a space instead of being trimmed."""
    p = col(parts)
    n = F.size(p)
    none = F.lit(None).cast("string")

    def part(t, i):
        following = F.regexp_replace(F.coalesce(F.get(p, i + 1), F.lit("")), r"^\s+", "")
        goes_on = (i < n - 1) & (following.rlike("^[a-z]") | ~following.startswith("#"))
        clean = without_edges(t, none if header is None else header, none if footer is None else footer)
        return T.let(clean, lambda c: F.when(goes_on & tail(t, c), F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit(" "))).otherwise(T.trimmed(c)))

    return F.array_join(F.transform(p, part), "\n\n")


def merged_pages(pages, header=None, footer=None) -> Column:
    """Page texts, without header and footer (columns), joined by blank lines; a page that ends within a sentence keeps a
    trailing space instead of being trimmed."""
    return _run_on(pages, lambda _, clean: ~F.regexp_replace(clean, r"\s+$", "").rlike(r"[.!?:;'\"]$"), header, footer)


def merged_windows(windows, header=None, footer=None) -> Column:
    """Markdown of windows (array) joined as merged_pages does, but a window runs on only if its last paragraph is open."""
    return _run_on(windows, lambda whole, _: T.let(T.last_paragraph(whole), lambda x: (x != "") & ~x.rlike(r"[.!?:;'\"]$")), header, footer)


def line_matches(line, patterns) -> Column:
    """Whether a line equals a pattern (array) apart from case and ends, or both are longer than five and alike by over 0.8."""
    return _matches(line, F.transform(patterns, _plain_line))


def _plain_line(x) -> Column:
    return F.lower(T.trimmed(x))


def _matches(line, plain) -> Column:
    """line_matches of patterns that are plain lines already; the line is made plain once."""
    alike = lambda a, p: (a == p) | ((F.length(a) > 5) & (F.length(p) > 5) & (T.similarity_ratio(a, p) > F.lit(0.8).cast("double")))
    return T.let(_plain_line(line), lambda a: F.exists(plain, lambda p: alike(a, p)))


def without_lines(text, patterns, number_pattern=None) -> Column:
    """A text without lines that match a pattern or, in any case, the page number's pattern (a string or a column); blank lines stay."""

    def drop(x, plain):
        hit = _matches(x, plain)
        return hit if number_pattern is None else hit | F.rlike(T.trimmed(x), F.concat(F.lit("(?i)"), number_pattern if isinstance(number_pattern, Column) else F.lit(number_pattern)))

    kept = T.let(F.transform(patterns, _plain_line), lambda plain: F.filter(T.lines(text), lambda x: (T.trimmed(x) == "") | ~drop(x, plain)))
    return T.trimmed(F.array_join(kept, "\n"))


def outline_depths(levels) -> Column:
    """The depth of each heading in the tree that levels make: a heading is below the last earlier one of a smaller level."""
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        above = F.filter(acc["stack"], lambda y: y < x)
        return F.struct(F.concat(above, F.array(x)).alias("stack"), F.concat(acc["out"], F.array(F.size(above) + 1)).alias("out"))

    return F.aggregate(levels, start, step)["out"]
