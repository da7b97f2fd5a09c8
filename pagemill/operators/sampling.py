"""Page samples and text samples, as expressions over a page count or an array of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import col, let


def picked(pages, numbers) -> Column:
    """The pages of an array with the numbers of another; the pages are worked out once, not for each number."""
    return let(col(pages), lambda p: F.transform(numbers, lambda i: F.get(p, (i - 1).cast("int"))))


def first_middle_last(n, k: int = 3) -> Column:
    """All pages up to k; else the first, the middle and the last, then every step-th until there are k."""
    n = col(n)
    step = F.floor(n / (k - 1)) if k > 1 else n
    own = F.array(F.lit(1).cast("long"), *([F.floor(n / 2)] if k >= 3 else []), *([n.cast("long")] if k >= 2 else []))
    more = F.transform(F.sequence(F.lit(1), F.lit(max(1, k - 2))), lambda i: (F.lit(1) + i * step).cast("long")) if k > 3 else F.array().cast("array<bigint>")
    picked = F.slice(F.array_distinct(F.concat(own, F.filter(more, lambda p: p <= n))), 1, k)
    return F.when(n <= k, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array_sort(picked))


def at_percentiles(n, percents=(10, 30, 50, 70, 90)) -> Column:
    n = col(n)
    pages = F.array(*(F.greatest(F.lit(1), F.least(n, F.floor(F.lit(p / 100) * (n - 1)) + 1)).cast("long") for p in percents))
    return F.array_sort(F.array_distinct(pages))


def for_structure(n, shares=(0.05, 0.20, 0.40, 0.60, 0.80, 0.95)) -> Column:
    n = col(n)
    pages = F.array(*(F.greatest(F.lit(1), F.least(n, F.floor(F.lit(s) * n + 0.5))).cast("long") for s in shares))
    return F.when(n <= 10, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array_distinct(pages))


def evenly(n, k: int, more_than: int) -> Column:
    """ceil(i * n / (k + 1)) for i up to k pages; none unless there are more than so many pages."""
    n = col(n)
    m = F.least(F.lit(k), n).cast("int")
    pages = F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.ceil(i * n / (m + 1)).cast("long"))
    return F.when(n > more_than, pages).otherwise(F.array().cast("array<bigint>"))


def head_text(pages, k: int, glue: str = "\n\n") -> Column:
    return F.array_join(F.slice(col(pages), 1, k), glue)


def head_middle_tail_text(pages) -> Column:
    """The first five pages, and the middle and the last of more than ten, a blank line after each."""
    p = col(pages)
    n = F.size(p)
    numbers = F.concat(F.sequence(F.lit(1), F.least(n, F.lit(5))), F.when(n > 10, F.array(F.floor(n / 2).cast("int"), n)).otherwise(F.array().cast("array<int>")))
    return F.array_join(F.transform(numbers, lambda i: F.concat(F.get(p, i - 1), F.lit("\n\n"))), "")


def tail(text, n: int) -> Column:
    return F.right(col(text), F.lit(n))
