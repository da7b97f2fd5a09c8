"""The conversion pipelines over a corpus: direct, light, full, intelligent, and the adaptive choice among them.

Each takes (doc_id, n, pages) and returns (doc_id, markdown, language, n_pages,
pipeline, contents, has_toc, level), the one result record of all.  A pipeline is an
expression over a document's pages, so the adaptive one is a single pass over the
corpus in which each row evaluates its own branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import features, layout, passes, sampling, structure, windows
from pagemill.operators import sections as S
from pagemill.operators.providers import Offline, Provider


def _answer(markdown: Column, language: Column, contents: Column, has_toc) -> Column:
    return F.struct(markdown.alias("markdown"), language.alias("language"), contents.alias("contents"), (has_toc if isinstance(has_toc, Column) else F.lit(has_toc)).alias("has_toc"))


def _shown(pages: Column, provider: Provider) -> Column:
    """Converted pages with notes for placeholders that are left over."""
    return F.transform(provider.contents(pages), lambda c: structure.placeholders_noted(c, True))


def edges(pages: Column, n: Column, k: int, more_than: int) -> Column:
    """struct<header,footer>: the lines that recur at either end of k pages spread over the document; null for none."""

    def mined(e, which):
        return T.let(F.filter(F.transform(e, lambda x: x[which]), lambda x: x.isNotNull()), layout.common_line)

    sampled = F.transform(sampling.picked(pages, sampling.evenly(n, k, more_than)), layout.edge_lines)
    return T.let(sampled, lambda e: F.struct(mined(e, "first").alias("header"), mined(e, "last").alias("footer")))


def direct_answer(pages: Column, n: Column, provider: Provider) -> Column:
    """Pages converted one by one and joined by blank lines; the language is the first page's."""
    first = T.language_by_presence(F.get(provider.contents(pages), F.lit(0)))
    return T.let(_shown(pages, provider), lambda p: _answer(F.array_join(p, "\n\n"), first, p, False))


def light_answer(pages: Column, n: Column, provider: Provider) -> Column:
    """As direct, without headers and footers that recur, sentences running on over page ends."""
    analysis = provider.analyze(sampling.head_text(pages, 5))
    told = F.struct(_shown(pages, provider).alias("p"), edges(pages, n, 5, 3).alias("e"), analysis.alias("a"))
    return T.let(told, lambda x: _answer(S.merged_pages(x["p"], x["e"]["header"], x["e"]["footer"]), x["a"]["language"], x["p"], x["a"]["has_toc"]))


def window_plan(pages: Column, n: Column, headings: Column, size: int = 50) -> Column:
    return T.let(F.transform(headings, lambda h: h["page"].cast("int")), lambda starts: windows.plan(n, starts, size))


def full_answer(pages: Column, n: Column, provider: Provider, size: int = 50) -> Column:
    """Windows that end where a section starts; each converted whole, and merged without recurring headers and footers."""
    analysis = provider.analyze(sampling.head_middle_tail_text(pages))
    parts = T.let(window_plan(pages, n, provider.headings(pages), size), lambda plan: provider.windows(pages, plan))
    told = F.struct(parts.alias("w"), edges(pages, n, 7, 4).alias("e"), analysis.alias("a"))
    return T.let(told, lambda x: _answer(S.merged_windows(x["w"], x["e"]["header"], x["e"]["footer"]), x["a"]["language"], x["w"], x["a"]["has_toc"]))


def organized_documents(paged: DataFrame, provider: Provider, keep=lambda e: e, include_toc: bool = True) -> DataFrame:
    """paged with _layout, _found, _raw and _markdown: layout and structure of sampled pages, linked sections of all pages,
    one organised document; keep: says for which rows."""
    for name, value in _passes(provider).items():
        paged = paged.withColumn(name, keep(value))
    return passes.organized(paged, keep, include_toc)


@T.once
def _passes(provider: Provider) -> dict[str, Column]:
    """The passes before a document is organised, each over the columns of those before it."""
    pages, n = F.col("pages"), F.col("n")
    both = F.struct(F.col("_profile").alias("layout"), F.col("_found").alias("found"))
    return {
        "_profile": passes.layout_pass(pages, n, provider),
        "_found": T.let(F.col("_profile"), lambda x: passes.structure_pass(pages, n, x, provider)),
        "_extracted": T.let(both, lambda x: passes.extraction(provider.converted(pages), x["layout"], x["found"])),
        "_raw": passes.raw_content(F.col("_extracted")),
    }


def intelligent_answer(pages: Column, n: Column, provider: Provider) -> Column:
    """Of organized_documents."""
    first = F.array_join(F.transform(F.slice(F.col("_raw")["sections"], 1, 5), lambda s: s["content"]), " ")
    return _answer(F.col("_markdown"), T.language_by_frequency(first), F.array("_markdown"), F.col("_found")["explicit"])


def legacy_answer(pages: Column, n: Column, provider: Provider) -> Column:
    """The earliest conversion: analysis of three pages, each page followed by a blank line, the earlier wording for lost images."""
    analysis = provider.analyze(sampling.head_text(pages, 3))
    shown = F.transform(provider.contents(pages), lambda c: structure.placeholders_told(c))
    return T.let(shown, lambda p: _answer(F.array_join(F.transform(p, lambda x: F.concat(x, F.lit("\n\n"))), ""), analysis["language"], p, analysis["has_toc"]))


ANSWERS = {"direct": direct_answer, "light": light_answer, "full": full_answer, "intelligent": intelligent_answer}
OFFLINE = Offline()


@T.once
def _made(pipeline: str, provider: Provider, options: tuple = ()) -> Column:
    make = legacy_answer if pipeline == "legacy" else ANSWERS[pipeline]
    return make(F.col("pages"), F.col("n"), provider, **dict(options))


def _run(paged: DataFrame, answer: Column, pipeline: Column, level: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    got = paged.select("doc_id", "n", pipeline.alias("pipeline"), answer.alias("a"), (F.lit(None).cast("string") if level is None else level).alias("level"), *keep)
    return got.select("doc_id", "a.markdown", "a.language", F.col("n").alias("n_pages"), "pipeline", "a.contents", "a.has_toc", "level", *keep)


def convert(paged: DataFrame, pipeline: str, provider: Provider | None = None, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """All documents by one pipeline; keep: further columns.  A provider's expressions are built once for each provider."""
    provider = provider or OFFLINE
    if pipeline == "intelligent":
        paged, options = organized_documents(paged, provider, **options), {}
    return _run(paged, _made(pipeline, provider, tuple(sorted(options.items()))), F.lit(pipeline), keep=keep)


def adaptive(paged: DataFrame, provider: Provider | None = None, force: str | None = None) -> DataFrame:
    """Each document by the plan that its factors choose, or all by force."""
    if force:
        return convert(paged, force, provider)
    provider, answer = provider or OFFLINE, None
    planned = organized_documents(with_plan(paged), provider, lambda e: F.when(F.col("pipeline") == "intelligent", e))
    for name in ANSWERS:
        one = _made(name, provider)
        answer = F.when(F.col("pipeline") == name, one) if answer is None else answer.when(F.col("pipeline") == name, one)
    return _run(planned, answer, F.col("pipeline"), F.col("level"))


def with_plan(paged: DataFrame) -> DataFrame:
    """paged with the pipeline chosen for each document, and its level of complexity."""
    planned = features.planned(features.factors(paged, keep=("n", "pages")))
    return planned.select("doc_id", "n", "pages", "pipeline", "level")
