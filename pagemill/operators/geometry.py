"""Vector graphics: paths of a drawing-operator stream, their clusters and kinds.

Operator numbers are fixed values of the page description: text begin and end,
path construction, rectangle, and the painting operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import col, let
from pagemill.operators.components import components
from pagemill.sources.shared import written

BEGIN_TEXT, END_TEXT, RECTANGLE, CONSTRUCT = 31, 32, 19, 91
STROKE, CLOSE_STROKE, FILL, EO_FILL, FILL_STROKE, EO_FILL_STROKE, CLOSE_FILL_STROKE, CLOSE_EO_FILL_STROKE = range(20, 28)
STROKES = (STROKE, CLOSE_STROKE, FILL_STROKE, EO_FILL_STROKE, CLOSE_FILL_STROKE, CLOSE_EO_FILL_STROKE)
FILLS = (FILL, EO_FILL, FILL_STROKE, EO_FILL_STROKE, CLOSE_FILL_STROKE, CLOSE_EO_FILL_STROKE)
MOVE, LINE, CURVE, CURVE2, CURVE3, CLOSE, RECT = 13, 14, 15, 16, 17, 18, 19
IMAGES = (85, 86, 87)
_USED = {MOVE: 2, LINE: 2, CURVE: 6, CURVE2: 4, CURVE3: 4, RECT: 4}


def path_bounds(sub_ops, coords, scale: float = 1.0, height: float = 0.0, transform: tuple | None = None) -> Column:
    """struct<min_x,min_y,max_x,max_y>: of the points of a path, by transform or else by scale with y flipped; zeros if empty."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cs = col(coords)
    at = lambda k: F.get(cs, k)
    used = lambda op: sum((F.when(op == k, n).otherwise(0) for k, n in _USED.items()), F.lit(0))

    def step(acc, op):
        i = acc["i"]
        pts = (
            F.when(op.isin(MOVE, LINE), F.array(point(at(i), at(i + 1))))
            .when(op == CURVE, F.array(point(at(i), at(i + 1)), point(at(i + 2), at(i + 3)), point(at(i + 4), at(i + 5))))
            .when(op.isin(CURVE2, CURVE3), F.array(point(at(i), at(i + 1)), point(at(i + 2), at(i + 3))))
            .when(op == RECT, F.array(point(at(i), at(i + 1)), point(at(i) + at(i + 2), at(i + 1) + at(i + 3))))
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )
        return F.struct((i + used(op)).cast("int").alias("i"), F.concat(acc["pts"], pts).alias("pts"))

    pts = F.aggregate(col(sub_ops), F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<x:double,y:double>>").alias("pts")), step)["pts"]
    if transform:
        a, b, c, d, e, f = transform
        fx, fy = (lambda p: p["x"] * a + p["y"] * c + e), (lambda p: p["x"] * b + p["y"] * d + f)
    else:
        fx, fy = (lambda p: p["x"] * scale), (lambda p: F.lit(height) - p["y"] * scale)
    zero = F.lit(0.0)

    def of(v):
        return F.struct(*(F.coalesce(v, zero).alias(n) for v, n in ((F.array_min(v["xs"]), "min_x"), (F.array_min(v["ys"]), "min_y"), (F.array_max(v["xs"]), "max_x"), (F.array_max(v["ys"]), "max_y"))))

    # The points are worked out once, and so are their places.
    return let(pts, lambda ps: let(F.struct(F.transform(ps, fx).alias("xs"), F.transform(ps, fy).alias("ys")), of))


def painted_paths(ops: DataFrame, skip_text: bool = True, least: float = 20.0, **view) -> DataFrame:
    """From (page_id, seq, op, sub_ops, coords): the painted paths of some size.

    The last path constructed before a painting operator is painted, once; what text blocks draw is skipped.
    """
    w = Window.partitionBy("page_id").orderBy("seq")
    text_mark = F.when(F.col("op") == BEGIN_TEXT, True).when(F.col("op") == END_TEXT, False)
    s = ops.withColumn("in_text", F.coalesce(F.last(text_mark, True).over(w), F.lit(False)))
    s = s.where(~F.col("op").isin(BEGIN_TEXT, END_TEXT))
    s = s.where(~F.col("in_text")) if skip_text else s
    c = F.col("coords")
    raw = F.struct(*(x.cast("double").alias(n) for x, n in ((F.get(c, F.lit(0)), "min_x"), (F.get(c, F.lit(1)), "min_y"), (F.get(c, F.lit(0)) + F.get(c, F.lit(2)), "max_x"), (F.get(c, F.lit(1)) + F.get(c, F.lit(3)), "max_y"))))
    bounds = F.when(F.col("op") == CONSTRUCT, path_bounds("sub_ops", "coords", **view)).when(F.col("op") == RECTANGLE, raw)
    count = F.when(F.col("op") == CONSTRUCT, F.size("sub_ops")).when(F.col("op") == RECTANGLE, 1)
    paints = F.col("op").isin(*range(STROKE, CLOSE_EO_FILL_STROKE + 1))
    s = s.where(F.col("op").isin(CONSTRUCT, RECTANGLE) | paints).withColumn("paints", paints).withColumn("bounds", bounds).withColumn("n", count)
    before = s.withColumn("b", F.lag("bounds").over(w)).withColumn("path_ops", F.lag("n").over(w)).withColumn("was_paint", F.lag("paints").over(w))
    got = before.where(F.col("paints") & ~F.coalesce("was_paint", F.lit(True)))
    out = got.select("page_id", "seq", "b.*", F.col("op").isin(*STROKES).alias("has_stroke"), F.col("op").isin(*FILLS).alias("has_fill"), "path_ops")
    return out.where(((F.col("max_x") - F.col("min_x")) >= least) | ((F.col("max_y") - F.col("min_y")) >= least))


def clusters(paths: DataFrame, gap: float = 15.0, crowd: int = 256) -> DataFrame:
    """Regions of paths that are near each other, transitively, page by page.

    Pages of up to crowd paths are grouped one by one, by an array fold; those of more by
    ``linked`` and connected components.  Both give the same regions.
    """
    path = F.struct("seq", "min_x", "min_y", "max_x", "max_y", "has_stroke", "has_fill", "path_ops")
    many = paths.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("page_id")
    few = paths.join(many, "page_id", "left_anti").groupBy("page_id").agg(F.array_sort(F.collect_list(path)).alias("ps"))
    groups = few.select("page_id", F.explode(folded("ps", gap)).alias("g")).select("page_id", F.posexplode("g").alias("k", "p"), F.get("g", F.lit(0))["seq"].alias("group"))
    rows = groups.select("page_id", "group", "p.*")
    if not many.isEmpty():
        kept = written(paths.join(many, "page_id", "left_semi").select("page_id", *(f"`{c}`" for c in ("seq", "min_x", "min_y", "max_x", "max_y", "has_stroke", "has_fill", "path_ops"))).withColumn("node", F.monotonically_increasing_id()), "paths")
        found = components(linked(kept, gap))
        rows = rows.unionByName(kept.join(found, "node", "left").select("page_id", F.coalesce("component", "node").alias("group"), *("seq", "min_x", "min_y", "max_x", "max_y", "has_stroke", "has_fill", "path_ops")))
    x, y = F.min("min_x"), F.min("min_y")
    out = rows.groupBy("page_id", "group").agg(
        F.min("seq").alias("cluster"), x.alias("x"), y.alias("y"), (F.max("max_x") - x).alias("width"), (F.max("max_y") - y).alias("height"), F.sum("path_ops").cast("long").alias("path_count"), F.bool_or("has_stroke").alias("has_stroke"),
        F.bool_or("has_fill").alias("has_fill"), F.least(F.lit(1.0), F.sum("path_ops") / 100).alias("complexity"), F.count(F.lit(1)).alias("paths"), F.min_by("path_ops", "seq").alias("first_ops"),
    )
    out = out.where((F.col("paths") >= 2) | (F.col("first_ops") >= 5)).drop("group", "paths", "first_ops")
    return out.withColumn("kind", region_kind())


def folded(paths, gap: float) -> Column:
    """Groups of an array of paths: each path in order joins all groups that it is near to."""
    near = lambda a, b: (
        (F.greatest(F.lit(0.0), F.greatest(a["min_x"], b["min_x"]) - F.least(a["max_x"], b["max_x"])) <= gap)
        & (F.greatest(F.lit(0.0), F.greatest(a["min_y"], b["min_y"]) - F.least(a["max_y"], b["max_y"])) <= gap)
    )
    kind = "array<array<struct<seq:bigint,min_x:double,min_y:double,max_x:double,max_y:double,has_stroke:boolean,has_fill:boolean,path_ops:int>>>"
    grouped = F.aggregate(
        paths,
        F.array().cast(kind),
        lambda acc, p: F.concat(
            F.filter(acc, lambda g: ~F.exists(g, lambda q: near(q, p))),
            F.array(F.concat(F.flatten(F.filter(acc, lambda g: F.exists(g, lambda q: near(q, p)))), F.array(p))),
        ),
    )
    return F.transform(grouped, lambda g: F.array_sort(g))


WIDE = 1024  #: cells that a path covers at most to be dealt with cell by cell


def linked(paths: DataFrame, gap: float) -> DataFrame:
    """(a, b): links between nodes of paths (page_id, node, min_x, min_y, max_x, max_y) that connect all that are within gap in both directions.

    Pages are cut into cells as wide as the gap.  All paths in a cell are near each other, so they are linked to one of
    them; for two cells side by side the outermost edges tell; for two that touch at a corner a running minimum along
    one direction does.  No pairs of a cell's paths are formed.  Paths that cover more than WIDE cells are joined with
    what lies in cells of their own size, and compared one by one: pairs grow with the number of such paths.
    """
    g = float(gap) if gap > 0 else 1.0  # a cell's width; with no gap only what is in one cell can touch, or in the next
    cell = lambda c, of=g: F.floor(F.col(c) / of).cast("long")
    size = (cell("max_x") - cell("min_x") + 1).cast("double") * (cell("max_y") - cell("min_y") + 1).cast("double")
    boxes = paths.select("page_id", "node", *(F.col(c).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y"))).withColumn("cells", size)
    small, wide = boxes.where(F.col("cells") <= WIDE), boxes.where(F.col("cells") > WIDE)
    spread = lambda lo, hi: F.explode(F.sequence(lo, hi))
    each = small.withColumn("cx", spread(cell("min_x"), cell("max_x"))).withColumn("cy", spread(cell("min_y"), cell("max_y")))
    if gap <= 0:
        return touching(boxes, wide, gap).unionAll(touching(boxes, small, gap)).distinct()
    cells = each.groupBy("page_id", "cx", "cy").agg(F.min("node").alias("head"), F.min("min_x").alias("left"), F.max("max_x").alias("right"), F.min("min_y").alias("low"), F.max("max_y").alias("high"))
    cells = written(cells, "cells")
    star = each.join(cells.select("page_id", "cx", "cy", "head"), ["page_id", "cx", "cy"]).select(F.col("head").alias("a"), F.col("node").alias("b"))
    beside = cells.select("page_id", (F.col("cx") - 1).alias("cx"), "cy", F.col("head").alias("b"), F.col("left").alias("next"))
    above = cells.select("page_id", "cx", (F.col("cy") - 1).alias("cy"), F.col("head").alias("b"), F.col("low").alias("next"))
    across = cells.join(beside, ["page_id", "cx", "cy"]).where(F.col("next") - F.col("right") <= gap).select(F.col("head").alias("a"), "b")
    upward = cells.join(above, ["page_id", "cx", "cy"]).where(F.col("next") - F.col("high") <= gap).select(F.col("head").alias("a"), "b")
    # Corners, one for each diagonal: of a path here, the right edge and the far one; of one there, the left and the near one.
    corner = []
    for way in (1, -1):
        here = each.select("page_id", "cx", "cy", F.lit(1).alias("role"), "node", (F.col("max_x") + gap).alias("u"), (F.col("max_y") + gap if way == 1 else gap - F.col("min_y")).alias("v"))
        there = each.select("page_id", (F.col("cx") - 1).alias("cx"), (F.col("cy") - way).alias("cy"), F.lit(0).alias("role"), "node", F.col("min_x").alias("u"), (F.col("min_y") if way == 1 else -F.col("max_y")).alias("v"))
        both = cells.select("page_id", "cx", "cy").join(cells.select("page_id", (F.col("cx") - 1).alias("cx"), (F.col("cy") - way).alias("cy")), ["page_id", "cx", "cy"])
        order = Window.partitionBy("page_id", "cx", "cy").orderBy("u", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lowest = F.min(F.when(F.col("role") == 0, F.struct("v", "node"))).over(order)
        met = here.unionByName(there).join(both, ["page_id", "cx", "cy"], "left_semi").withColumn("lowest", lowest).where((F.col("role") == 1) & (F.col("lowest.v") <= F.col("v")))
        corner.append(met.select(F.col("node").alias("a"), F.col("lowest.node").alias("b")))
    return star.unionAll(across).unionAll(upward).unionAll(corner[0]).unionAll(corner[1]).unionAll(touching(boxes, wide, gap)).distinct()


def touching(boxes: DataFrame, wide: DataFrame, gap: float) -> DataFrame:
    """(a, b): the wide boxes with all boxes near them, by cells of a size of which each wide box covers a few."""
    power = lambda c: F.ceil(F.log2(F.greatest(c, F.lit(1.0)))).cast("int")
    level = power(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 2 * gap)
    wide = wide.withColumn("level", level)
    levels = wide.select("page_id", "level").distinct()
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo / F.pow(F.lit(2.0), F.col("level"))).cast("long"), F.floor(hi / F.pow(F.lit(2.0), F.col("level"))).cast("long")))
    # Of two boxes, the greater one's level counts; of two of one level, each meets the other.
    mine = wide.withColumn("cx", spread(F.col("min_x") - gap, F.col("max_x") + gap)).withColumn("cy", spread(F.col("min_y") - gap, F.col("max_y") + gap))
    others = boxes.withColumn("own", level).join(levels, "page_id").where(F.col("own") <= F.col("level"))
    others = others.withColumn("cx", spread(F.col("min_x"), F.col("max_x"))).withColumn("cy", spread(F.col("min_y"), F.col("max_y")))
    named = others.select("page_id", "level", "cx", "cy", F.col("node").alias("b"), *(F.col(c).alias(f"o_{c}") for c in ("min_x", "min_y", "max_x", "max_y")))
    apart = lambda lo, hi: F.greatest(F.col(lo), F.col(f"o_{lo}")) - F.least(F.col(hi), F.col(f"o_{hi}"))
    met = mine.join(named, ["page_id", "level", "cx", "cy"]).where((F.col("node") != F.col("b")) & (apart("min_x", "max_x") <= gap) & (apart("min_y", "max_y") <= gap))
    return met.select(F.col("node").alias("a"), "b").distinct()


def region_kind() -> Column:
    c = F.col
    ratio = c("width") / F.when(c("height") == 0, 1.0).otherwise(c("height"))
    return (
        F.when((c("width") < 200) & (c("height") < 200) & (ratio > 0.5) & (ratio < 2) & c("has_fill"), "logo")
        .when(((ratio > 10) | (ratio < 0.1)) & (c("path_count") < 5), "decoration")
        .when((c("path_count") > 20) & c("has_stroke") & c("has_fill"), "diagram")
        .when((ratio > 0.5) & (ratio < 3) & (c("path_count") > 10), "chart")
        .otherwise("unknown")
    )


def crop_box(ymin, xmin, ymax, xmax, width, height) -> Column:
    """Pixels of a box given in thousandths: origin, and size rounded down."""
    x, y = col(xmin) / 1000 * col(width), col(ymin) / 1000 * col(height)
    return F.struct(x.alias("x"), y.alias("y"), F.floor((col(xmax) - col(xmin)) / 1000 * col(width)).cast("long").alias("w"), F.floor((col(ymax) - col(ymin)) / 1000 * col(height)).cast("long").alias("h"))


def svg_placeholder(x, y, w, h, kind) -> Column:
    return F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%s %s %s %s"><rect x="%s" y="%s" width="%s" height="%s" fill="none"/><text>[Vector Graphic: %s]</text></svg>', x, y, w, h, x, y, w, h, kind)
