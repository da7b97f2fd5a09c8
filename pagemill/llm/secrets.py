"""Secret scans over a trigram inverted index, by DataFrame expressions only.

``trigram_query`` derives from a rule's regex the Boolean query of trigrams that
each match must contain.  ``index`` writes the postings of all trigrams that some
query names: a list of texts for each trigram, in blocks, so that no list of a common
trigram meets in one task.  ``candidates`` intersects and joins the lists block by
block.  The texts found are verified by the regex; rules without a mandatory trigram
scan all rows.  Texts are known by a hash; two of one hash only make more candidates.

Defined cases: a null text counts as empty; repeated rows and equal ids are each
scanned alone; an empty table gives an empty one; other columns stay, whatever their
names, but for ``spans``, which is replaced.  Very long texts are scanned whole; the
work grows with a text's length and its matches.  Matches are leftmost and
non-overlapping within a kind, and those that fail the kind's length condition are
dropped afterwards.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import let, prefix, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: of this group,
    least: int = 0  #: at least so many characters


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are whole: the same as [0-9a-f]+ with 16 or more
)
MORE_RULES = (
    Rule("forge", r"gh[ps]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[bp]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)

MOST = 64  #: strings that a part of a pattern may stand for before it counts as any


def _grams(s: str):
    """The first and the last trigram of a mandatory string: the postings of those between hardly narrow an intersection."""
    return frozenset((s[:3], s[-3:]))


def _absorbed(q):
    """Without alternatives that another one implies."""
    return q and frozenset(a for a in q if not any(b < a for b in q))


def _all(parts) -> tuple | frozenset | None:
    """AND of queries; a query is None (anything), or a set of alternatives, each a set of trigrams."""
    out = None
    for q in parts:
        if q is not None:
            out = q if out is None else frozenset(a | b for a in out for b in q)
            if len(out) > MOST:
                return None
    return out


def _any(parts):
    parts = list(parts)
    return None if any(q is None for q in parts) else frozenset().union(*parts)


def _of(strings):
    """What a match that contains one of the strings must contain."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    low = {s.lower() for s in strings}
    return _absorbed(frozenset(_grams(s) for s in low if not any(t != s and t in s for t in low)))


def _walk(tree) -> tuple[frozenset | None, frozenset | None]:
    """(all strings it can be, if few; its query)."""
    run, met, whole = frozenset([""]), [], True
    for op, arg in tree:
        exact = query = None
        if op is rc.LITERAL:
            exact = frozenset([chr(arg)])
        elif op is rc.IN and all(k is rc.LITERAL for k, _ in arg) and len(arg) <= 8:
            exact = frozenset(chr(v) for _, v in arg)
        elif op is rc.SUBPATTERN:
            exact, query = _walk(arg[3])
        elif op is rc.BRANCH:
            each = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in each):
                exact = frozenset().union(*(e for e, _ in each))
            query = _any(_of(e) if e is not None else q for e, q in each)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, sub = arg
            e, q = _walk(sub)
            if (least, most) == (0, 1) and e is not None:
                exact = e | {""}
            elif least >= 1:
                query = q if e is None else _of(e)
        elif op is rc.AT:
            exact = frozenset([""])
        joined = frozenset(a + b for a in run for b in exact) if exact is not None else None
        if joined is not None and len(joined) <= MOST:
            run = joined
            continue
        met += [_of(run), query if exact is None else _of(exact)]
        run, whole = frozenset([""]), False
    return (run if whole else None), _all([*met, _of(run)])


def trigram_query(pattern: str) -> frozenset | None:
    """A set of alternatives, each a set of lower-cased trigrams that a match must contain; None: no mandatory trigram."""
    return _walk(rp.parse(pattern))[1]


SPAN = "array<struct<start:int,order:int,end:int>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,order,end>> of a rule's kept matches."""
    pattern = F.lit(rule.pattern)
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern)
    shown = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    sizes = F.zip_with(F.arrays_zip(hits.alias("hit"), shown.alias("shown")), gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(h["hit"]), F.lit(0)).alias("hit"), F.coalesce(F.length(h["shown"]), F.lit(-1)).alias("shown")))

    def placed(v):
        before = prefix(F.transform(v, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
        spans = F.zip_with(v, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("order"), (at + x["gap"] + x["hit"]).alias("end"), x["shown"].alias("shown")))
        kept = F.filter(spans, lambda x: (x["shown"] >= rule.least) & (x["end"] > x["start"]))  # the last gap has no match after it
        return F.transform(kept, lambda x: F.struct(x["start"], x["order"], x["end"]))

    return F.when(text.rlike(rule.pattern), let(sizes, placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


SALTS = 16  #: parts that the rows of one text are dealt to
LIST_ROWS = 1 << 16  #: keys in a block of the index


def index(texts: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """(block, gram, keys): the postings of the grams, a sorted list of text keys (xxhash64) for each block of about LIST_ROWS keys.

    Copies of a text have one key.  Lists are made map side first and never hold more than a block's keys.
    """
    blocks = max(1, -(-texts.count() // LIST_ROWS))
    low = F.lower(F.col(text))  # may fold more than A-Z, which only adds candidates
    has = let(low, lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))
    hits = texts.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("key"), F.explode(has).alias("gram"))
    return hits.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def candidates(postings: DataFrame, queries: list[frozenset | None]) -> DataFrame:
    """(key, rules): the bits of the rules whose query a text's trigrams fulfil: lists are intersected within an alternative, and joined over all."""
    none = F.array().cast("array<bigint>")
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("of"))

    def fulfilled(q) -> Column:
        out = none
        for a in sorted(q, key=sorted):
            found = None
            for g in sorted(a):
                one = F.coalesce(F.element_at("of", F.lit(g)), none)
                found = one if found is None else F.array_intersect(found, one)
            out = F.array_union(out, found)
        return out

    each = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bit"), fulfilled(q).alias("keys")) for k, q in enumerate(queries) if q))
    found = lists.select(F.explode(each).alias("f")).select(F.col("f.bit").alias("bit"), F.explode("f.keys").alias("key"))
    return found.groupBy("key").agg(F.bit_or("bit").alias("rules"))


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """df with spans: array<struct<kind,start,end>> by start, then by the rules' order."""
    names = [f"c{k}" for k in range(len(df.columns))]  # whatever df's columns are called
    body, queries = F.coalesce(F.col(names[df.columns.index(text)]), F.lit("")), [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries if q for a in q for g in a})
    plain = df.toDF(*names)
    if grams:
        found = candidates(written(index(plain, grams, names[df.columns.index(text)]), "postings"), queries)
        # What is found grows with the input: no broadcast, however little it is here.  Copies of a text share a key, and are dealt out by a salt.
        asked = plain.withColumn("key", F.xxhash64(names[df.columns.index(text)])).withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))
        found = found.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        plain = asked.join(found.hint("merge"), ["key", "salt"], "left").withColumn("rules", F.coalesce("rules", F.lit(0).cast("long")))
    each = []
    for order, (r, q) in enumerate(zip(rules, queries, strict=True)):
        hit = _spans(body, r, order)
        each.append(hit if not q else F.when(F.col("rules").bitwiseAND(F.lit(1 << order).cast("long")) != 0, hit).otherwise(F.array().cast(SPAN)))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.transform(F.array_sort(F.concat(*each)), lambda s: F.struct(F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    kept = [(n, c) for n, c in zip(names, df.columns, strict=True) if c != "spans"]
    return plain.select(*(F.col(n).alias(c) for n, c in kept), spans.alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]", segment: int = 4096) -> Column:
    """text with each maximal run of overlapping spans replaced by mark; null stays null.

    A substring is found by walking from the begin, so a long text is cut into segments first.
    """

    def between(parts, a, b):
        """Code points a to b of the text that parts make up."""
        part = lambda k: F.substr(F.get(parts, k), (F.greatest(a - k * segment, F.lit(0)) + 1).cast("int"), (F.least(b, (k + 1) * segment) - F.greatest(a, k * segment)).cast("int"))
        return F.when(a >= b, "").otherwise(F.array_join(F.transform(F.sequence(F.floor(a / segment).cast("int"), F.floor((b - 1) / segment).cast("int")), part), ""))

    def of(x):
        parts, before = x["parts"], x["before"]
        kept = F.transform(spans, lambda s, i: F.when(s["start"] < F.get(before, i), "").otherwise(F.concat(between(parts, F.get(before, i), s["start"]), F.lit(mark))))
        last = F.greatest(F.get(before, F.size(before) - 1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(kept, ""), between(parts, last, F.length(text)))

    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / segment).cast("int")), lambda k: F.substr(text, k * segment + 1, F.lit(segment)))
    both = F.struct(cut.alias("parts"), prefix(F.transform(spans, lambda s: s["end"]), F.greatest).alias("before"))
    return F.when(F.size(spans) > 0, let(both, of)).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
