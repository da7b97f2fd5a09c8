"""The passes of the intelligent conversion, as expressions over the array of a document's pages.

Layout and structure come from a provider's answers about sampled pages; extraction
splits pages into linked sections, footnotes and images; organisation merges,
repairs, places footnotes and renders.  A document is one row and stays one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import layout as L
from pagemill.operators import prompts, sampling, structure
from pagemill.operators import sections as S

NOTE = "struct<id:string,content:string>"


def layout_pass(pages: Column, n: Column, provider) -> Column:
    """A document's layout profile from sampled pages (see layout.document_profile)."""
    answer = lambda p, t: F.struct(p.alias("page"), provider.layout_answer(t, p, n).alias("a"))
    numbers = sampling.at_percentiles(n)
    return T.let(F.zip_with(numbers, sampling.picked(pages, numbers), answer), L.document_profile)


def page_layout(text: Column, page: Column, total: Column, provider) -> Column:
    """A page's profile from the call that converts it, or from a chat if that says nothing."""
    prompt = prompts.layout(text, page, total)
    return T.let(L.page_profile(provider.convert(text)["content"]), lambda a: F.when(L.is_default(a), L.page_profile(provider.chat(prompt))).otherwise(a))


def structure_samples(pages: Column, n: Column, layout: Column) -> Column:
    """array<struct<page,text>> of the pages that tell the structure, without repeated lines."""
    repeated = F.concat(layout["headers"], layout["footers"])
    clean = lambda t: S.without_lines(t, repeated, layout["page_numbers"])
    numbers = sampling.for_structure(n)
    return F.zip_with(numbers, sampling.picked(pages, numbers), lambda p, t: F.struct(p.alias("page"), clean(t).alias("text")))


def structure_pass(pages: Column, n: Column, layout: Column, provider) -> Column:
    """A document's structure profile (see structure.profile)."""
    return structure.profile(provider.structure_answer(prompts.structure(structure_samples(pages, n, layout), n)), n)


def filter_pattern(patterns: Column) -> Column:
    """One regex for any of the lines of an array; null for none."""
    return F.when(F.size(patterns) > 0, F.array_join(F.transform(patterns, T.escaped_regex), "|"))


def extraction(converted: Column, layout: Column, found: Column) -> Column:
    """By page: struct<page,sections,notes,images,last,open>, sections linked to those they continue.

    converted: array by page of struct<content,summary,last_paragraph,images>; found: the structure profile.
    """

    def page(c, i):
        number = (i + 1).cast("string")
        kinds = F.coalesce(F.map_entries(c["images"]), F.array().cast("array<struct<key:string,value:struct<bbox:array<double>,description:string,type:string>>>"))
        images = F.transform(
            kinds,
            lambda e: F.struct(
                e["key"].alias("id"),
                e["value"]["description"].alias("description"),
                L.decorative(e["value"]["description"], e["value"]["type"], F.get(e["value"]["bbox"], F.lit(1)), F.get(e["value"]["bbox"], F.lit(0)), (i + 1).cast("long"), layout["decorative"], layout["positions"], layout).alias("decorative"),
            ),
        )

        def of(clean):
            notes = S.by_style(layout["footnote_style"], lambda k: S.footnotes(clean, k), F.array().cast(f"array<{NOTE}>"))
            body = S.by_style(layout["footnote_style"], lambda k: S.without_footnotes(clean, k), clean)

            def of_parts(p):
                last = F.size(p["parsed"])
                shown = F.transform(F.filter(p["images"], lambda x: ~x["decorative"]), lambda x: x["id"])
                sections = F.transform(
                    p["parsed"],
                    lambda s: F.struct(
                        F.concat(F.lit("section-"), number, F.lit("-"), s["n"].cast("string")).alias("id"),
                        s["level"].alias("level"),
                        s["title"].alias("title"),
                        s["content"].alias("content"),
                        S.references(s["content"], p["notes"]).alias("refs"),
                        F.when(s["n"] == last, shown).otherwise(F.array().cast("array<string>")).alias("shown"),
                    ),
                )
                return F.struct((i + 1).alias("page"), sections.alias("sections"), p["notes"].alias("notes"), p["images"].alias("images"), c["last_paragraph"].alias("last"), T.ends_incomplete(p["body"]).alias("open"))

            whole = F.struct(body.alias("body"), notes.alias("notes"), images.alias("images"), S.parse(body, found["max_depth"]).alias("parsed"))
            return T.let(whole, of_parts)

        return T.let(S.without_repeated(c["content"], F.concat(layout["headers"], layout["footers"]), layout["page_numbers"]), of)

    return T.let(F.transform(converted, page), linked)


def pending(page: Column) -> Column:
    """The id of the section that the next page may continue: the last one of a page that ends within a sentence."""
    return F.when(page["open"] & (F.size(page["sections"]) > 0), F.element_at(page["sections"], -1)["id"])


def linked(pages: Column) -> Column:
    """pages (see extraction) with continues_from in their sections: every section that goes on from the page before."""

    def page(p, i):
        before = F.get(pages, i - 1)
        link = lambda s: F.when(pending(before).isNotNull() & T.continues(before["last"], s["content"]), pending(before))
        sections = F.transform(p["sections"], lambda s: F.struct(*(s[x].alias(x) for x in ("id", "level", "title", "content", "refs", "shown")), link(s).alias("continues_from")))
        return F.struct(p["page"].alias("page"), sections.alias("sections"), *(p[x].alias(x) for x in ("notes", "images", "last", "open")))

    return F.transform(pages, page)


def raw_content(pages: Column) -> Column:
    """struct<sections,notes,images,pending> of a whole document; of notes and images with one id the last one holds."""
    last_wins = lambda x: T.let(x, lambda a: F.filter(a, lambda y, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda z: z["id"] == y["id"])))
    flat = lambda name: F.flatten(F.transform(pages, lambda p: p[name]))
    return F.struct(
        flat("sections").alias("sections"),
        last_wins(flat("notes")).alias("notes"),
        last_wins(F.filter(flat("images"), lambda x: ~x["decorative"])).alias("images"),
        F.filter(F.transform(pages, pending), lambda x: x.isNotNull()).alias("pending"),
    )


NONE = "array<string>"


def first_uses(sections: Column, notes: Column) -> Column:
    """For each section the ids of its footnotes that no earlier section refers to; ids without a definition are left out."""
    known = F.transform(sections, lambda s: F.filter(s["refs"], lambda i: F.exists(notes, lambda x: x["id"] == i)))

    def of(known):
        before = F.aggregate(known, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x))))
        both = F.struct(F.flatten(known).alias("flat"), before.alias("before"))
        return T.let(both, lambda b: F.transform(known, lambda ids, k: F.filter(ids, lambda i: F.array_position(b["flat"], i) > F.get(b["before"], k))))

    return T.let(known, of)


def chapters(sections: Column, levels: Column) -> Column:
    """struct<chapter,heads>: for each section the section (by place) that begins its chapter, and the last one before it that
    was of level 1 before repairs; -1 for none."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1))
    chapter = F.aggregate(levels, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(F.when(v == 1, F.size(a)).otherwise(last(a)).cast("int"))))
    heads = F.aggregate(sections, F.array(F.lit(-1)), lambda a, s: F.concat(a, F.array(F.when(s["level"] == 1, F.size(a) - 1).otherwise(last(a)).cast("int"))))
    return F.struct(chapter.alias("chapter"), heads.alias("heads"))


def emitted(x: Column, include_toc: bool = True) -> Column:
    """Markdown from struct<sections,levels,first,chapters,notes,images,found>: contents list, sections, and footnotes after
    their section, before the next chapter goes on, or at the end, as the document's type has them."""
    none = F.array().cast(NONE)
    placement, c = S.placement(x["found"]["document_type"]), x["chapters"]
    told = lambda i: F.concat(F.lit("[^"), i, F.lit("]: "), F.get(F.filter(x["notes"], lambda y: y["id"] == i), F.lit(0))["content"])
    listed = lambda ids: F.array_join(F.transform(ids, told), "\n")
    notes_of = lambda k: F.flatten(F.filter(x["first"], lambda _, j: F.get(c["chapter"], j) == k))
    block = lambda k: F.when(F.size(notes_of(k)) > 0, F.array(F.concat(F.lit("\n\n---\n\n"), listed(notes_of(k))))).otherwise(none)
    images = F.map_from_entries(F.transform(x["images"], lambda y: F.struct(y["id"], F.struct(y["description"].alias("description"), F.lit("").alias("url"), F.lit(False).alias("decorative")))))

    def rows(s, k):
        ids, level = F.get(x["first"], k), F.get(x["levels"], k)
        body = S.rendered(level, s["title"], s["content"], lambda t: F.when(F.contains(t, F.lit("image:")), structure.images_resolved(t, images)).otherwise(t))
        shown = T.let(body, lambda b: F.when(T.trimmed(b) != "", F.array(b, F.lit(""))).otherwise(none))
        inline = F.flatten(F.transform(ids, lambda i: F.array(told(i), F.lit(""))))
        done = F.get(c["heads"], k)
        return F.concat(shown, F.when(placement == "inline", inline).when((placement == "section-end") & (level == 1) & (done >= 0), block(done)).otherwise(none))

    lines = F.flatten(F.transform(x["sections"], rows))
    # Chapters whose notes no later one has let out: one whose level was repaired, and the last one.
    begins = F.array_distinct(F.filter(c["chapter"], lambda k: k >= 0))
    left = F.filter(begins, lambda k: (F.get(x["sections"], k)["level"] != 1) | (k == F.array_max(begins)))
    all_ = F.flatten(x["first"])
    at_end = F.when(F.size(all_) > 0, F.array(F.lit(""), F.lit("---"), F.lit(""), F.lit("## Notes"), F.lit(""), listed(all_))).otherwise(none)
    ends = F.when(placement == "section-end", F.flatten(F.transform(left, block))).when(placement == "document-end", at_end).otherwise(none)
    toc = F.when(F.lit(include_toc) & (F.size(x["found"]["toc"]) > 0), F.array(S.toc(x["found"]["toc"]))).otherwise(none)
    return T.cleaned_markdown(F.array_join(F.concat(toc, lines, ends), "\n"))


def organized(raw: DataFrame, keep=lambda e: e, include_toc: bool = True) -> DataFrame:
    """raw (columns _raw and _found, see raw_content and structure.profile) with _markdown; keep: says for which rows.

    Each step is a column of its own, so that what several later ones use is worked out once.
    """
    for name, value in _steps(include_toc).items():
        raw = raw.withColumn(name, keep(value))
    return raw


@T.once
def _steps(include_toc: bool) -> dict[str, Column]:
    parts = F.struct(*(F.col("_" + x).alias(y) for x, y in (("merged", "sections"), ("levels", "levels"), ("first", "first"), ("chapters", "chapters"), ("found", "found"))), F.col("_raw")["notes"].alias("notes"), F.col("_raw")["images"].alias("images"))
    return {
        "_merged": S.merged(F.col("_raw")["sections"], ("refs", "shown")),
        "_levels": S.repaired_levels(F.transform("_merged", lambda s: s["level"])),
        "_first": first_uses(F.col("_merged"), F.col("_raw")["notes"]),
        "_chapters": chapters(F.col("_merged"), F.col("_levels")),
        "_markdown": T.let(parts, lambda x: emitted(x, include_toc)),
    }
