"""Prompts for live providers, as columns where a conversion is an expression and as plain strings per call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYOUT = """Describe the layout of page {page} of {total} as one JSON object with the keys headerZone and footerZone (top and
bottom in percent of the height), marginZones (left and right in percent of the width), headerText, footerText and
pageNumberPattern (as printed, or null), decorativeImages (a list of zone and description), footnoteStyle (numbered, symbolic or
none) and columnLayout (single, double or mixed). The page's text:
"""
STRUCTURE = """Describe the structure of a document of {total} pages as one JSON object with the keys documentType (academic, book,
report, marketing, manual, legal or other), toc (explicit, and entries of level, title, page and children), hierarchy (maxDepth),
sections (frontMatter, body and backMatter with start and end) and crossReferences (footnoteStyle and citationStyle). Text of
some of its pages, without what repeats on each:
"""
SAMPLE = 3000  #: characters of a page that a prompt shows


def layout(text: Column, page: Column, total: Column) -> Column:
    head, middle = LAYOUT.split("{page}")
    middle, rest = middle.split("{total}")
    return F.concat(F.lit(head), page.cast("string"), F.lit(middle), total.cast("string"), F.lit(rest), F.left(text, F.lit(SAMPLE)))


def structure(samples: Column, total: Column) -> Column:
    """samples: array<struct<page,text>>."""
    head, rest = STRUCTURE.split("{total}")
    told = F.transform(samples, lambda s: F.concat(F.lit("--- page "), s["page"].cast("string"), F.lit("\n"), F.left(s["text"], F.lit(SAMPLE))))
    return F.concat(F.lit(head), total.cast("string"), F.lit(rest), F.array_join(told, "\n"))


def page(context: dict) -> str:
    """What a call that converts a page is told: its place, what came before, what is expected and what to leave out."""
    lines = [
        f"Convert page {context['page']} of {context['total']} (language: {context['language']}) to Markdown.",
        "Answer with [CONTENT], [IMAGES] and JSON of placeholders with bbox and description, [SUMMARY] and [LAST_PARAGRAPH].",
    ]
    if context.get("section"):
        lines.append(f"The page is within the section: {context['section']}")
    if context.get("headings"):
        lines += ["Headings expected on it:", *(f"{'#' * h['level']} {h['title']}" for h in context["headings"])]
    for key, told in (("header", "Leave out the header"), ("footer", "Leave out the footer"), ("summary", "Before it"), ("previous", "The text before it ends")):
        if context.get(key):
            lines.append(f"{told}: {context[key]}")
    return "\n".join(lines)


def window(context: dict) -> str:
    """What a call that converts a window of pages is told."""
    lines = [f"Convert pages {context['start']} to {context['end']} of {context['total']} (window {context['window']} of {context['windows']}, {context['percent']} %) to Markdown."]
    if context.get("continued"):
        lines.append(f"The window begins within the section: {context['continued']}")
    if context.get("goes_on"):
        lines.append("Its last section goes on after it.")
    lines += [f"{'#' * h['level']} {h['title']} (page {h['page']})" for h in context.get("headings", ())]
    for key, told in (("header", "Leave out the header"), ("footer", "Leave out the footer"), ("summary", "Before it"), ("previous", "The text before it ends")):
        if context.get(key):
            lines.append(f"{told}: {context[key]}")
    return "\n".join(lines)

IMAGE = """What does this picture show? Answer with one JSON object and nothing else:
{"type": one of "photo", "diagram", "chart", "logo", "icon", "screenshot", "other",
 "description": a short sentence, "isPureVector": true or false, "complexity": a number from 0 to 1}"""
