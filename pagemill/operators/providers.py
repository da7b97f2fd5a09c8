"""The model boundary: an interface, a registry, and a deterministic offline provider.

The offline provider answers with column expressions, so that conversions with it
stay within one plan.  A live provider (``live.LiveProvider``) implements the calls
as plain functions, and a conversion with it runs them through
``execution.robust_calls`` before the same expressions.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import layout, passes, structure
from pagemill.operators import sections as S


class Provider(Protocol):
    """What conversions ask for, as expressions: answered offline within the plan, or read from columns that calls have filled."""

    def analyze(self, text: Column) -> Column: ...

    def headings(self, pages: Column) -> Column: ...

    def contents(self, pages: Column) -> Column: ...

    def converted(self, pages: Column) -> Column: ...

    def windows(self, pages: Column, plan: Column) -> Column: ...

    def layout_answer(self, text: Column, page: Column, total: Column) -> Column: ...

    def structure_answer(self, prompt: Column) -> Column: ...


class Offline:
    """No model: pages convert to themselves, headings are those they show, and chat gives an empty object, so that defaults hold."""

    name, native_pages = "offline", None

    def analyze(self, text: Column) -> Column:
        return F.struct(
            T.language_by_presence(text).alias("language"),
            T.table_runs(text).alias("tables"),
            T.any_of(text, T.CODE).alias("has_code"),
            T.any_of(text, T.MATH).alias("has_math"),
            text.rlike(r"(?im)^\s*(?:#+\s*)?(?:table of )?contents\s*$").alias("has_toc"),
        )

    def headings(self, pages: Column) -> Column:
        """array<struct<level,title,page>>."""

        def of(page, i):
            shown = F.filter(T.lines(page), lambda x: x.rlike(S.HEADING))
            return F.transform(shown, lambda x: F.struct(F.length(F.regexp_extract(x, S.HEADING, 1)).alias("level"), T.trimmed(F.regexp_extract(x, S.HEADING, 2)).alias("title"), (i + 1).cast("long").alias("page")))

        return F.flatten(F.transform(pages, of))

    def convert(self, page: Column) -> Column:
        return F.struct(page.alias("content"), self.summarize(page, 300).alias("summary"), T.last_paragraph(page).alias("last_paragraph"), F.lit(None).cast(structure.PLACED).alias("images"))

    def contents(self, pages: Column) -> Column:
        """The Markdown of each page."""
        return pages

    def converted(self, pages: Column) -> Column:
        """array<struct<content,summary,last_paragraph,images>>."""
        return F.transform(pages, self.convert)

    def windows(self, pages: Column, plan: Column) -> Column:
        """Markdown of each window."""
        shown = F.transform(pages, lambda p: structure.placeholders_noted(p))
        return T.let(shown, lambda p: F.transform(plan, lambda w: F.array_join(F.slice(p, w["start"], w["end"] - w["start"] + 1), "\n\n")))

    def layout_answer(self, text: Column, page: Column, total: Column) -> Column:
        return passes.page_layout(text, page, total, self)

    def structure_answer(self, prompt: Column) -> Column:
        return self.chat(prompt)

    def summarize(self, text: Column, most: int = 500) -> Column:
        return F.left(text, F.lit(most))

    def chat(self, prompt: Column) -> Column:
        return F.when(prompt.isNotNull(), F.lit("{}"))

    def classify_image(self, description: Column) -> Column:
        return F.struct(F.lit("other").alias("type"), description.alias("description"), F.lit(False).alias("is_pure_vector"), F.lit(0.5).alias("complexity"))

    def validate(self) -> bool:
        return True

    def cost(self, pages: Column, complexity: Column, of: str = "vision") -> Column:
        return structure.cost(pages, complexity, of)


class Recorded(Offline):
    """Answers of a live provider that calls have put into columns (see operators.live)."""

    name = "recorded"

    def analyze(self, text: Column) -> Column:
        return F.col("_analysis")

    def headings(self, pages: Column) -> Column:
        return F.col("_headings")

    def contents(self, pages: Column) -> Column:
        return F.transform("_converted", lambda c: c["content"])

    def converted(self, pages: Column) -> Column:
        return F.col("_converted")

    def windows(self, pages: Column, plan: Column) -> Column:
        return F.transform("_windows", lambda w: w["content"])

    def layout_answer(self, text: Column, page: Column, total: Column) -> Column:
        return layout.page_profile(F.element_at("_layout", page.cast("string")))

    def structure_answer(self, prompt: Column) -> Column:
        return F.col("_structure")


class NotConfigured(LookupError):
    pass


class Registry:
    """Providers by name, made on first use and kept until their configuration changes."""

    def __init__(self):
        self._makers, self._configs, self._made = {"offline": lambda _: Offline()}, {"offline": {}}, {}

    def register(self, name: str, maker) -> None:
        self._makers[name] = maker

    def configure(self, name: str, **config) -> None:
        if name not in self._makers:
            raise NotConfigured(name)
        self._configs[name] = config
        self._made.pop(name, None)

    def supported(self) -> list[str]:
        return sorted(self._makers)

    def configured(self) -> list[str]:
        return [n for n in self._configs if n in self._makers]

    def get(self, name: str | None = None) -> Provider:
        name = name or next(iter(self.configured()), None)
        if name not in self._configs or name not in self._makers:
            raise NotConfigured(str(name))
        if name not in self._made:
            self._made[name] = self._makers[name](self._configs[name])
        return self._made[name]
