"""Output checks: format warnings, structure of Markdown, fuzzy heading matches, tolerances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.text import col
from pagemill.sources.shared import written

PASS = 0.9  #: similarity of a matching heading


def format_warnings(text) -> list[Column]:
    t = col(text)
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return [
        (T.trimmed(t) != "").alias("parseable"),
        count(r"!\[[^\]]*\]\(\s*\)").alias("broken_images"),
        (count(r"\[") - count(r"\]")).alias("open_brackets"),
        t.rlike(r"(?m)\]\([^)]*$").alias("open_link"),
        F.size(F.filter(T.lines(t), lambda x: F.length(x) > 500)).cast("long").alias("long_lines"),
    ]


def elements(text) -> list[Column]:
    """Counts of headings by level, images, tables and fenced code blocks (ATX, pipe and fence syntax)."""
    t = col(text)
    outside = F.regexp_replace(t, r"(?ms)^```.*?^```[ \t]*$", "")
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("long")
    return [
        *(count(outside, rf"(?m)^#{{{k}}}[ \t]+\S").alias(f"h{k}") for k in range(1, 7)),
        count(outside, r"!\[[^\]]*\]\([^)]*\)").alias("images"),
        count(outside, r"(?m)^\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$").alias("tables"),
        count(t, r"(?ms)^```.*?^```[ \t]*$").alias("code_blocks"),
    ]


def blocks(text) -> Column:
    """struct<tables: array<struct<rows,columns>>, languages: array<string>> of Markdown: each table's rows with its header, and each fenced
    block's language, empty if none is named.

    One walk over the lines: a table begins with a line of as many cells as the delimiter
    line below it, and goes on until a blank line or another block; a fence ends with one
    of its own kind that is as long, or with the text.
    """
    fence, shut = r"^ {0,3}(`{3,}|~{3,})", r"^ {0,3}(`{3,}|~{3,})[ \t]*$"
    delimiter = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
    other = r"^ {0,3}(#{1,6}([ \t]|$)|>|[-*+][ \t]|[0-9]{1,9}[.)][ \t]|(-[ \t]*){3,}$|(\*[ \t]*){3,}$|(_[ \t]*){3,}$)"
    kind = "struct<fence:string,header:int,inside:boolean,tables:array<struct<rows:int,columns:int>>,languages:array<string>>"
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("header"), F.lit(False).alias("inside"), F.array().cast("array<struct<rows:int,columns:int>>").alias("tables"), F.array().cast("array<string>").alias("languages")).cast(kind)

    def cells(line):
        of = lambda t, bars: F.when(bars > 0, bars + 1 - t.startswith("|").cast("int") - (t.rlike(r"(?<!\\)\|$") & (F.length(t) > 1)).cast("int")).otherwise(F.when(t != "", 1).otherwise(0)).cast("int")
        return T.let(T.trimmed(line), lambda t: T.let(F.regexp_count(t, F.lit(r"(?<!\\)\|")), lambda bars: of(t, bars)))

    def facts(line):
        """What the walk asks of a line, each once."""

        def of_mark(mark):
            info = T.trimmed(F.regexp_replace(line, fence, ""))
            opens = (mark != "") & ~(mark.startswith("`") & F.contains(info, F.lit("`")))
            return F.struct(
                F.when(mark != "", F.when(opens, mark)).alias("mark"),
                F.when(mark != "", F.regexp_extract(line, shut, 1)).otherwise("").alias("shut"),
                F.when(mark != "", F.regexp_extract(info, r"^([^ \t]*)", 1)).alias("language"),
                cells(line).alias("n"),
                line.rlike(other).alias("other"),
                (F.contains(line, F.lit("|")) & line.rlike(delimiter)).alias("rule"),
                line.rlike(r"^(    |\t)").alias("indented"),
            )

        return T.let(F.regexp_extract(line, fence, 1), of_mark)

    def step(acc, x):
        state = lambda **new: F.struct(*(new.get(k, acc[k]).alias(k) for k in ("fence", "header", "inside", "tables", "languages"))).cast(kind)
        none, off = F.lit(0), F.lit(False)
        last = F.element_at(acc["tables"], -1)
        longer = F.concat(F.slice(acc["tables"], F.lit(1), F.size(acc["tables"]) - 1), F.array(F.struct((last["rows"] + 1).alias("rows"), last["columns"].alias("columns"))))
        n = x["n"]
        return (
            F.when(acc["fence"] != "", F.when(x["shut"].startswith(acc["fence"]), state(fence=F.lit(""))).otherwise(acc))
            .when(x["mark"].isNotNull(), state(fence=x["mark"], header=none, inside=off, languages=F.concat(acc["languages"], F.array(x["language"]))))
            .when(~acc["inside"] & (acc["header"] == n) & (n > 0) & x["rule"], state(inside=F.lit(True), header=none, tables=F.concat(acc["tables"], F.array(F.struct(F.lit(1).alias("rows"), n.alias("columns"))))))
            .when(acc["inside"] & (n > 0) & ~x["other"], state(tables=longer))
            .otherwise(state(inside=off, header=F.when(x["other"] | x["indented"], none).otherwise(n)))
        )

    walked = T.let(F.aggregate(F.transform(T.lines(text), facts), start, step), lambda w: w)
    return F.struct(walked["tables"].alias("tables"), walked["languages"].alias("languages"))


def content_of(text) -> Column:
    """struct<images,tables,code_blocks> of Markdown, as content_report takes it."""
    outside = F.regexp_replace(col(text), r"(?ms)^ {0,3}```.*?^ {0,3}```[ \t]*$", "")
    images = F.regexp_count(outside, F.lit(r"!\[[^\]]*\]\([^)]*\)"))
    return T.let(blocks(text), lambda b: F.struct(images.cast("long").alias("images"), F.size(b["tables"]).cast("long").alias("tables"), F.size(b["languages"]).cast("long").alias("code_blocks")))


def fixture_report(documents: DataFrame, fixtures: DataFrame, tolerance: int = 1) -> DataFrame:
    """(name, actual and expected counts, content_report): conversions (name, markdown) against expectation files (corpus.read_fixtures); documents of either."""
    wanted = fixtures.select("name", F.struct(*(F.col(f"content.{c}.count").cast("long").alias(n) for c, n in (("images", "images"), ("tables", "tables"), ("codeBlocks", "code_blocks")))).alias("expected"))
    both = documents.select("name", content_of("markdown").alias("actual")).join(wanted, "name", "full")
    report = [F.coalesce(c, F.lit(False)).alias(n) for c, n in zip(content_report("actual", "expected", tolerance), ("images_ok", "tables_ok", "code_blocks_ok", "content_ok"), strict=True)]
    return both.select("name", "actual", "expected", *report)


def within(actual, expected, tolerance: int = 1) -> Column:
    return F.abs(col(actual) - col(expected)) <= tolerance


def _grams(df: DataFrame, prefix: str) -> DataFrame:
    """df with the normal form without spaces, and its numbered two-letter parts, once for each heading."""
    plain = T.match_plain("text")
    return df.withColumn(f"{prefix}_plain", plain).withColumn(f"{prefix}_grams", T.numbered_bigrams(plain))


def _likeness(p, q, g, h) -> Column:
    common = F.size(F.array_intersect(g, h))
    s = F.when(p == q, 1.0).when((F.length(p) < 2) | (F.length(q) < 2), 0.0).otherwise(2.0 * common / (F.size(g) + F.size(h)))
    return F.round(s, 6)


SIDE = 1 << 12  #: headings of a document and level, of either table, that are compared as matrices


def best_matches(expected: DataFrame, actual: DataFrame, least: float = PASS, crowd: int = 1 << 20) -> DataFrame:
    """For each expected heading (doc_id, ord, level, text): the most similar actual one of the document and level, the
    first of equal ones.

    Documents and levels of up to crowd pairs are compared pair by pair, those of more by ``rare_matches``; both give the
    same.  What grows with the documents is joined by sort and merge: written tables of parts are small as files only.
    """
    here = ["doc_id", "level"]
    crowded = (F.col("n") * F.col("m") > crowd) | (F.greatest("n", "m") > SIDE) & (F.least("n", "m") > 0)
    both = expected.select(*here, F.lit(1).alias("own")).unionByName(actual.select(*here, F.lit(0).alias("own")))
    many = both.groupBy(*here).agg(F.sum("own").alias("n"), F.sum(1 - F.col("own")).alias("m")).where(crowded).select(*here)
    many = written(many, "many")
    if many.isEmpty():
        return paired_matches(expected, actual, least)
    of, apart = (lambda df, how=how: df.join(many.hint("merge"), here, how) for how in ("left_semi", "left_anti"))
    columns = ["doc_id", "ord", "level", "text", "match", "similarity", "matched"]
    return paired_matches(apart(expected), apart(actual), least).select(*columns).unionByName(rare_matches(of(expected), of(actual), least).select(*columns))


def paired_matches(expected: DataFrame, actual: DataFrame, least: float) -> DataFrame:
    """Pair by pair: the headings of a document and level, actual ones first, follow each other in sorted partitions."""
    columns = ["doc_id", "level", "role", "ord", "text", "plain"]
    kinds = {c: expected.schema[c].dataType.simpleString() for c in ("doc_id", "ord", "level", "text")}
    rows = [df.select("doc_id", F.col("level").cast(kinds["level"]).alias("level"), F.lit(role).alias("role"), F.col("ord").cast(kinds["ord"]).alias("ord"), "text") for role, df in ((0, actual), (1, expected))]
    both = rows[0].unionByName(rows[1]).repartition("doc_id", "level").sortWithinPartitions("doc_id", "level", "role", "ord").select(*columns[:-1], T.match_plain("text").alias("plain"))

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            begins = group_begins(t)
            # The last group may go on in the next batch.
            held = t.slice(begins[-1])
            yield from told(t, begins)
        if held is not None and held.num_rows:
            yield from told(held.combine_chunks(), np.array([0, held.num_rows]))

    def told(t, begins):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(t["plain"]), 0).to_numpy()) // PART
        k = 0
        while k + 1 < len(begins):
            more = k + 1
            while more + 1 < len(begins) and sizes[begins[more + 1] - 1] == sizes[begins[k]]:
                more += 1
            part = t.slice(begins[k], begins[more] - begins[k]).combine_chunks()
            yield from matched(part, begins[k : more + 1] - begins[k])
            k = more

    def matched(t, begins):
        role = t["role"].to_numpy()
        mine = np.flatnonzero(role)
        if not len(mine):
            return
        best, score = most_alike(t["plain"].combine_chunks() if isinstance(t["plain"], pa.ChunkedArray) else t["plain"], role, begins)
        at = pa.array(best[mine], pa.int64(), mask=best[mine] < 0)
        own = t.take(pa.array(mine))
        s = np.maximum(score[mine], 0) / 1e6
        out = {"doc_id": own["doc_id"], "ord": own["ord"], "level": own["level"], "text": own["text"], "match": t["text"].take(at), "similarity": pa.array(s), "matched": pa.array(s >= least)}
        yield from pa.table(out).to_batches()

    return both.mapInArrow(run, f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, level {kinds['level']}, text {kinds['text']}, match string, similarity double, matched boolean")


PART = 4 << 20  #: bytes of headings whose two-letter parts are sorted at once
PLACES = 1 << 17  #: parts up to which a table gives their numbers within a group
BLOCK = 1 << 12  #: different parts that are compared at once


def group_begins(t: pa.Table) -> np.ndarray:
    """Where the groups of a sorted table's (doc_id, level) begin, the last one too."""
    n = t.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in ("doc_id", "level"):
        x = t[c].combine_chunks()
        differ = pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        empty = x.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= np.asarray(differ, bool) | (empty[1:] != empty[:-1])
    return np.flatnonzero(new)


def most_alike(plain, role: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of role 1: the row of role 0 of its group whose text is most alike, the first of equal ones, or -1; and how much, in millionths.

    Texts without a value are like nothing (-1).
    """
    n = len(plain)
    codes, length = T.code_points(plain)
    row, token = T.numbered_parts(codes, length)
    ends = np.searchsorted(row, begins)
    empty = plain.is_null().to_numpy(zero_copy_only=False)
    same = pc.fill_null(plain.dictionary_encode().indices, -1).to_numpy()
    few = int(token.max(initial=-1)) < PLACES  # not where a letter is repeated over and over
    place = np.zeros(int(token.max(initial=-1)) + 1 if few else 0, np.int64)
    best, score = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for k in range(len(begins) - 1):
        lo, hi = begins[k], begins[k + 1]
        mid = lo + int(np.searchsorted(role[lo:hi], 1))
        if lo == mid or mid == hi:
            continue
        r, t = row[ends[k] : ends[k + 1]] - lo, token[ends[k] : ends[k + 1]]
        # Numbers from 0 for the parts of this group.
        if few:
            place[t] = 1
            used = np.flatnonzero(place)
            place[used] = np.arange(len(used))
            t = place[t]
            place[used] = 0
        else:
            t = np.unique(t, return_inverse=True)[1]
        common = np.zeros((hi - mid, mid - lo), np.float32)
        for first in range(0, int(t.max(initial=-1)) + 1, BLOCK):
            own = (t >= first) & (t < first + BLOCK) if first or t.max() >= BLOCK else slice(None)
            has = np.zeros((hi - lo, min(BLOCK, int(t.max()) + 1 - first)), np.float32)
            has[r[own], t[own] - first] = 1
            common += has[mid - lo :] @ has[: mid - lo].T
        p, q = length[mid:hi, None], length[None, lo:mid]
        whole = np.maximum(p + q - 2, 1)
        # 2 c / whole in millionths, halves up, by whole numbers.
        s = (4_000_000 * common.astype(np.int64) + whole) // (2 * whole)
        s[(p < 2) | (q < 2)] = 0
        s[same[mid:hi, None] == same[None, lo:mid]] = 1_000_000
        s[empty[mid:hi, None] | empty[None, lo:mid]] = -1
        at = s.argmax(axis=1)
        best[mid:hi], score[mid:hi] = lo + at, s[np.arange(hi - mid), at]
    return best, score


def rare_matches(expected: DataFrame, actual: DataFrame, least: float) -> DataFrame:
    """Texts with the same two-letter parts come first, by a join on these; then those that can reach least, by a join on
    pairs of the rarest of their parts, of which such texts share one; only what has no match by then is compared with all texts
    of its document and level, equal texts once."""
    e = written(_grams(expected.select("doc_id", "ord", "level", "text"), "e").withColumn("id", F.monotonically_increasing_id()), "expected")
    first = actual.groupBy("doc_id", "level", "text").agg(F.min("ord").alias("a_ord"))
    a = written(_grams(first, "a").withColumnRenamed("text", "a_text"), "actual")
    rank = F.struct("s", -F.col("a_ord"))
    chosen = F.max_by(F.struct("a_text", "s"), rank).alias("m")
    told = lambda pairs: pairs.groupBy("id").agg(chosen)
    scored = lambda pairs: pairs.withColumn("s", _likeness(F.col("e_plain"), F.col("a_plain"), F.col("e_grams"), F.col("a_grams")))
    here = ["doc_id", "level"]
    # Alike: the same parts, in whatever order; texts without parts have to be equal.
    form = lambda p: F.when(F.length(f"{p}_plain") < 2, F.concat(F.lit("="), f"{p}_plain")).otherwise(F.array_join(F.col(f"{p}_grams").cast("array<string>"), " "))
    same = told(scored(e.withColumn("form", form("e")).join(a.withColumn("form", form("a")).hint("merge"), [*here, "form"])))
    same = written(same, "same")
    left = e.join(same.hint("merge"), "id", "left_anti")
    tokens = lambda df, id_, p: df.select(*here, id_, F.size(f"{p}_grams").alias("n"), F.explode(f"{p}_grams").alias("gram"))
    mine, theirs = tokens(left, "id", "e"), tokens(a, "a_ord", "a")
    often = mine.select(*here, "gram").unionAll(theirs.select(*here, "gram")).groupBy(*here, "gram").agg(F.count(F.lit(1)).alias("often"))
    share = (least - 1e-6) / (2 - least + 1e-6)  # of a text's parts that one of such a similarity has, too

    reach = lambda n: F.ceil(n * share).cast("int")

    def keys(t: DataFrame, id_: str) -> DataFrame:
        """Two by two, the rarest parts: so many that texts of that similarity have two of them in common; single ones of texts that may have but one."""
        ordered = t.join(often.hint("merge"), [*here, "gram"]).groupBy(*here, id_, "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("g"))
        first = lambda more: F.transform(F.slice("g", F.lit(1), F.col("n") - reach(F.col("n")) + more), lambda x: x["gram"].cast("string"))
        pairs = lambda g: F.flatten(F.transform(g, lambda x, i: F.transform(F.slice(g, i + 2, F.size(g)), lambda y: F.concat_ws(" ", x, y))))
        two = F.when(reach(F.col("n")) >= 2, pairs(first(2))).otherwise(F.array().cast("array<string>"))
        one = F.when(reach(reach(F.col("n"))) < 2, first(1)).otherwise(F.array().cast("array<string>"))
        return ordered.select(*here, id_, "n", F.explode(F.concat(one, two)).alias("key"))

    other = keys(theirs, "a_ord").withColumnRenamed("n", "m")
    sized = (F.col("m") >= reach(F.col("n"))) & (F.col("n") >= reach(F.col("m")))
    near = keys(mine, "id").join(other.hint("merge"), [*here, "key"]).where(sized).select("id", "a_ord", *here).distinct()
    near = scored(near.join(e.hint("merge"), ["id", *here]).join(a.hint("merge"), [*here, "a_ord"])).where(F.col("s") >= least)
    near = written(told(near), "near")
    rest = scored(left.join(near.hint("merge"), "id", "left_anti").join(a.hint("merge"), here, "left")).withColumn("s", F.when(F.col("a_text").isNotNull(), F.col("s")))
    best = e.join(same.unionByName(near).unionByName(told(rest)).hint("merge"), "id", "left")
    s = F.coalesce("m.s", F.lit(0.0))
    return best.select("doc_id", "ord", "level", "text", F.col("m.a_text").alias("match"), s.alias("similarity"), (s >= least).alias("matched"))


def image_url_ok(url) -> Column:
    u = col(url)
    return F.when(u.startswith("data:image/"), F.length(u) > 50).when(u.rlike("^https?://"), True).when(u.startswith("./") | u.startswith("/"), True).otherwise(u.rlike(r"(?i)^[\w-]+\.(png|jpg|jpeg|gif|webp|svg)$"))


def structure_report(expected: DataFrame, actual: DataFrame, least: float = PASS) -> DataFrame:
    """(doc_id, h1 ... h6, hierarchy_errors, hierarchy_valid, expected, matched): actual headings by level, levels that skip one,
    and how many expected headings (both: doc_id, ord, level, text) have a match; documents of either table."""
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("ord"))
    skips = actual.select("doc_id", "level", ((before > 0) & (F.col("level") > before + 1)).alias("skips"))
    counts = skips.groupBy("doc_id").agg(*(F.count_if(F.col("level") == k).cast("long").alias(f"h{k}") for k in range(1, 7)), F.count_if("skips").cast("long").alias("hierarchy_errors"))
    found = best_matches(expected, actual, least).groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("expected"), F.count_if("matched").cast("long").alias("matched"))
    both = counts.join(found.hint("merge"), "doc_id", "full")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in (*(f"h{k}" for k in range(1, 7)), "hierarchy_errors", "expected", "matched")]
    return both.select("doc_id", *numbers).withColumn("hierarchy_valid", F.col("hierarchy_errors") == 0)


def content_report(actual, expected, tolerance: int = 1) -> list[Column]:
    """From structs with images, tables and code_blocks: whether each number is within the tolerance, and all of them."""
    ok = {x: within(col(actual)[x], col(expected)[x], tolerance) for x in ("images", "tables", "code_blocks")}
    return [*(v.alias(f"{k}_ok") for k, v in ok.items()), (ok["images"] & ok["tables"] & ok["code_blocks"]).alias("content_ok")]
