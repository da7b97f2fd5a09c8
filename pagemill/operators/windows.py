"""Page windows of large documents: planning on section breaks, context, merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import col


def plan(n, starts, size: int = 50, look_back: int = 10) -> Column:
    """array<struct<window,start,end>> that tile pages 1 to n.

    starts: section start pages in order.  A window of size pages ends earlier where a section starts in its last
    look_back pages: right before the last such start in order (each later than the break before it).
    """
    n, starts = col(n).cast("int"), col(starts)
    most = F.greatest(F.lit(1), n)

    def step(acc, _):
        ideal = F.least(acc["at"] + size - 1, n)
        # 0 stands for no break; a break on page 0 counts as none, too.
        brk = F.aggregate(starts, F.lit(0), lambda b, s: F.when((s >= ideal - look_back) & (s <= ideal) & ((b == 0) | (s > b)), s - 1).otherwise(b).cast("int"))
        end = F.when((brk > 0) & (brk > acc["at"]), brk).otherwise(ideal).cast("int")
        more = F.struct((F.size(acc["out"]) + 1).cast("int").alias("window"), acc["at"].alias("start"), end.alias("end"))
        return F.when(acc["at"] <= n, F.struct((end + 1).cast("int").alias("at"), F.concat(acc["out"], F.array(more)).alias("out"))).otherwise(acc)

    # Windows are no shorter than size - look_back - 1 pages but for the last, which bounds their number.
    rounds = F.sequence(F.lit(1), (F.ceil(most / max(1, size - look_back - 1)) + 1).cast("int"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<window:int,start:int,end:int>>").alias("out"))
    return F.aggregate(rounds, start, step)["out"]


def percent(k, total) -> Column:
    return F.floor(col(k) / col(total) * 100 + F.lit(0.5)).cast("long")


def expected(total, pages, start, end) -> Column:
    """The window's share of a document-wide estimate, rounded up."""
    return F.ceil(col(total) / F.when(col(pages) == 0, 1).otherwise(col(pages)) * (col(end) - col(start) + 1)).cast("long")


def continued(headings, start) -> Column:
    """The title of the last heading (array<struct<level,title,page>>, in order) of level 1 or 2 before a window; null on page 1."""
    before = F.filter(col(headings), lambda h: (h["page"] < col(start)) & (h["level"] <= 2))
    return F.when(col(start) > 1, F.get(before, F.size(before) - 1)["title"])


def goes_on(spans, start, end) -> Column:
    """Whether a section (array<struct<start,end>>) of the window ends after it."""
    return F.exists(col(spans), lambda s: (s["start"] <= col(end)) & (s["end"] >= col(start)) & (s["end"] > col(end)))
