"""Scalar text functions as Column expressions: detectors, normalisers, similarity.

All but ``dice`` stay inside Catalyst.  Words are bounded by ASCII look-arounds rather than
``\\b``, whose meaning differs between regex engines.
"""

from __future__ import annotations

import functools
from collections.abc import Hashable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(f):
    """f, called once for each JVM and for the same arguments (those that have a hash): the expressions of a conversion, which
    take seconds to build, are shared by all queries that need them."""

    @functools.lru_cache(maxsize=64)
    def made(jvm, *args):
        return f(*args)

    @functools.wraps(f)
    def run(*args):
        return made(SparkContext._gateway, *args) if all(isinstance(a, Hashable) for a in args) else f(*args)

    return run


def let(value, f) -> Column:
    """f(value) with value evaluated once: an expression used within a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def trimmed(x) -> Column:
    """Without white space of any ASCII kind at either end."""
    return F.btrim(col(x), F.lit(WHITE))


def lines(x) -> Column:
    return F.split(col(x), "\n")


def any_of(x, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | col(x).rlike(p)
    return out


# Detectors. The patterns are fixed values.
CODE = (r"```[\s\S]*?```", r"function\s+\w+\s*\(", r"def\s+\w+\s*\(", r"class\s+\w+\s*[:{]", r"import\s+.*from", r"(?i)</?[a-z][a-z0-9]*[^>]*>")
MATH = (r"\$.*\$", r"\\\[.*\\\]", r"\\frac\{", r"\\sum|\\int|\\prod", "[∑∫∏∂∇]", "[α-ωΑ-Ω]")
FOOTNOTE = (r"\[\d+\]", r"\(\d+\)", r"(?m)\d+\.\s+[A-Z].*\n", "[¹²³⁴⁵⁶⁷⁸⁹⁰]+", r"\*{1,3}\s+\w", "†|‡|§", r"(?m)^[\t\s]*\d+[.)]\s+.{10,}")
# Stop words by language, in order of precedence (fixed values).
PRESENCE = (
    ("English", ("the", "and", "of", "to", "in")),
    ("German", ("und", "der", "die", "das", "ist")),
    ("French", ("le", "la", "de", "et", "est")),
    ("Spanish", ("el", "la", "de", "y", "en")),
    ("Russian", ("и", "в", "на", "не", "с")),
)
FREQUENCY = (
    ("en", ("the", "and", "of", "to", "in")),
    ("de", ("und", "der", "die", "das", "ist")),
    ("fr", ("le", "la", "de", "et", "des")),
    ("es", ("el", "la", "de", "y", "en")),
    ("ru", ("и", "в", "на", "с", "от")),
)


def word(w: str) -> str:
    """A pattern for the word; the literal comes first, which regex engines search for fast."""
    return rf"{w}(?<![A-Za-z0-9_]{w})(?![A-Za-z0-9_])" if w.isascii() else rf"{w}(?<=[A-Za-z0-9_]{w})(?=[A-Za-z0-9_])"


def first_max(names, counts, least: int, default: str) -> Column:
    """The name of the first largest count, if that is least or more."""
    names = F.array(*map(F.lit, names))
    return let(counts, lambda c: F.when(F.array_max(c) >= least, F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))).otherwise(F.lit(default)))


def language_by_presence(x) -> Column:
    """The language most of whose stop words occur, if three do."""
    counts = lambda t: F.array(*(sum((t.rlike(word(w)).cast("int") for w in words), F.lit(0)) for _, words in PRESENCE))
    return first_max([n for n, _ in PRESENCE], let(F.lower(col(x)), counts), 3, "Unknown")


def language_by_frequency(x) -> Column:
    """The language whose stop words occur most often in the first 2000 characters."""
    counts = lambda t: F.array(*(sum((F.regexp_count(t, F.lit(word(w))) for w in words), F.lit(0)) for _, words in FREQUENCY))
    return first_max([n for n, _ in FREQUENCY], let(F.left(F.lower(col(x)), F.lit(2000)), counts), 1, "en")


def table_runs(x) -> Column:
    """Maximal runs of three or more lines that look like table rows."""

    def row(line: Column) -> Column:
        count = lambda p: F.regexp_count(line, F.lit(p))
        return (count(r"\|") >= 2) | ((count(r"\t") >= 2) & (count(r"\d+") >= 3))

    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("found"))
    # A run counts when it reaches its third line.
    walked = F.aggregate(
        lines(x),
        state,
        lambda s, line: F.struct(F.when(row(line), s["run"] + 1).otherwise(F.lit(0)).alias("run"), (s["found"] + (row(line) & (s["run"] == 2)).cast("int")).alias("found")),
    )
    return walked["found"]


def structure_depth(x) -> Column:
    """The deepest numbering or heading mark at the begin of a line, 1 to 6."""
    numbered = lambda line: F.regexp_count(F.regexp_extract(line, r"^((?:\d+\.)+)", 1), F.lit(r"\d+"))
    marked = lambda line: F.length(F.regexp_extract(line, r"^(#+)\s", 1))
    return F.least(F.lit(6), F.greatest(F.lit(1), F.array_max(F.transform(lines(x), lambda li: F.greatest(numbered(li), marked(li))))))


def multi_column(x) -> Column:
    ls = lines(x)
    gaps = F.size(F.filter(ls, lambda li: li.rlike(r"\s{4,}")))
    return (F.size(ls) > 5) & (gaps / F.size(ls) > F.lit(0.2).cast("double"))


def density(avg_chars) -> Column:
    return F.when(col(avg_chars) < 500, "sparse").when(col(avg_chars) > 2500, "dense").otherwise("normal")


def ends_incomplete(x) -> Column:
    t = F.regexp_replace(col(x), r"\s+$", "")
    return (F.length(t) > 0) & ~t.rlike(r"[.!?:;'\"]$")


def continues(previous, current) -> Column:
    p, c = trimmed(previous), trimmed(current)
    return F.coalesce((F.length(p) > 0) & (F.length(c) > 0) & ends_incomplete(p) & (c.rlike("^[a-z]") | ~c.startswith("#")), F.lit(False))


def normalized_line(x) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"\d+", "N"), r"\s+", " "))


def escaped_regex(x) -> Column:
    return F.regexp_replace(col(x), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def similarity_ratio(a, b) -> Column:
    """Containment gives short / long; else the share of the shorter's characters that the longer has at all."""
    a, b = col(a), col(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    hits = F.length(short) - F.length(F.call_function("translate", short, long, F.lit("")))
    return F.when(F.length(long) == 0, 1.0).when(F.contains(long, short), F.length(short) / F.length(long)).otherwise(hits / F.length(long))


def match_normal(x) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"\s+", " "), r"[^A-Za-z0-9_\s]", ""))


def match_plain(x) -> Column:
    """match_normal without spaces: the letters that are left when all else goes, whatever white space was between."""
    return F.regexp_replace(F.lower(col(x)), r"[^a-z0-9_]+", "")


CODES = 0x110000  #: code points there are
TIMES = 1 << 22  #: occurrences of one two-letter part that are told apart within a text


def bigrams(x) -> Column:
    """Two-letter parts without white space, as array<long> of both letters' code points."""
    t = F.regexp_replace(col(x), r"\s", "")
    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c).cast("long"))
    parts = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * CODES + b)
    return let(t, lambda t: F.when(F.length(t) < 2, F.array().cast("array<long>")).otherwise(let(codes(t), parts)))


def numbered_bigrams(x) -> Column:
    """Two-letter parts in order; the k-th occurrence of one gets the number k, so that sets of them can be intersected."""

    def of(s):
        begins = F.filter(F.transform(s, lambda g, i: F.when((i == 0) | (F.get(s, i - 1) != g), i)), lambda i: i.isNotNull())
        many = lambda p, q: F.transform(F.sequence(F.lit(0), q - p - 1), lambda k: F.get(s, p) * TIMES + k)
        return let(begins, lambda at: F.flatten(F.transform(at, lambda p, k: many(p, F.coalesce(F.get(at, k + 1), F.size(s))))))

    return let(F.sort_array(bigrams(x)), of)


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points of an Arrow array of strings, one after the other, and each string's number of them."""
    return np.frombuffer("".join(pc.drop_null(texts).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64), pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64)


CELLS = 1 << 22  #: of a table of counts


def counted_parts(codes: np.ndarray, length: np.ndarray):
    """(first row, counts) of some rows at a time: how often each row has each two-letter part there is; a generator."""
    names, at = np.unique(codes, return_inverse=True) if len(codes) and codes.max() >= 1 << 16 else (None, codes)
    if names is None and len(codes):
        used = np.flatnonzero(np.bincount(codes))
        place = np.zeros(used[-1] + 1, np.int64)
        place[used] = np.arange(len(used))
        names, at = used, place[codes]
    row = np.repeat(np.arange(len(length)), length)
    inside = row[1:] == row[:-1]
    two, row = (at[:-1] * (0 if names is None else len(names)) + at[1:])[inside], row[1:][inside]
    many = 1 if names is None else len(names) ** 2
    if many > CELLS >> 8:  # so many letters that most parts are not there
        parts, two = np.unique(two, return_inverse=True)
        many = max(len(parts), 1)
    step = max(2, CELLS // many // 2 * 2)  # even: pairs of rows stay together
    for lo in range(0, len(length), step):
        n = min(step, len(length) - lo)
        i, j = np.searchsorted(row, (lo, lo + n))
        yield lo, np.bincount((row[i:j] - lo) * many + two[i:j], minlength=n * many).reshape(n, many)


def numbered_parts(codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) of all two-letter parts by row: the k-th occurrence of one in a row is another than the first."""
    rows, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, counts in counted_parts(codes, length):
        r, c = np.nonzero(counts)
        times = counts[r, c]
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows.append(np.repeat(r + lo, times))
        parts.append(k * counts.shape[1] + np.repeat(c, times))
    return np.concatenate(rows), np.concatenate(parts)


def dice(a, b) -> Column:
    """Bigram multiset similarity of two strings, white space aside."""

    @F.pandas_udf("double")
    def alike(p: pd.Series, q: pd.Series) -> pd.Series:
        x, y = (pa.array(s, pa.string(), from_pandas=True) for s in (p, q))
        (c, m), (d, o) = code_points(x), code_points(y)
        # Strings and their partners are rows by turns.
        both = np.stack([m, o], axis=1).ravel()
        place = np.cumsum(both) - both
        letters = np.empty(len(c) + len(d), np.int64)
        for own, n, begin in ((c, m, place[::2]), (d, o, place[1::2])):
            letters[np.arange(len(own)) + np.repeat(begin - (np.cumsum(n) - n), n)] = own
        common = np.zeros(len(both) // 2)
        for lo, counts in counted_parts(letters, both):
            k = lo + np.arange(len(counts) - 1)
            k = k[k % 2 == 0]
            common[k // 2] = np.minimum(counts[k - lo], counts[k - lo + 1]).sum(axis=1)
        s = 2.0 * common / np.maximum(m + o - 2, 1)
        s[(m < 2) | (o < 2)] = 0.0
        s[(p == q).to_numpy()] = 1.0
        return pd.Series(s).mask((p.isna() | q.isna()).to_numpy())

    return alike(*(F.regexp_replace(col(x), r"\s", "") for x in (a, b)))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9\s-]", ""), r"\s+", "-")


def cleaned_markdown(x) -> Column:
    """The seven clean-up steps in order."""
    t = F.regexp_replace(col(x), r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    t = F.concat(trimmed(t), F.lit("\n"))
    t = F.regexp_replace(t, r"(?m)^[-*+]\s*$", "")
    t = F.regexp_replace(t, r"(?m)^#{1,6}\s*$", "")
    t = F.regexp_replace(t, r"(?m)^(#{1,6})\s+\1\s+", "$1 ")
    return F.regexp_replace(t, r"(?m)^[-*_]{3,}$", "---")


def footnote_markers(x) -> Column:
    """[n], (n) and ^n become [^n], one after the other (two digits are wrapped twice, as is compatible)."""
    t = F.regexp_replace(col(x), r"\[(\d+)\](?!\()", "[^$1]")
    t = F.regexp_replace(t, r"\((\d+)\)(?!\[)", "[^$1]")
    return F.regexp_replace(t, r"\^(\d+)(?!\])", "[^$1]")


def last_paragraph(x) -> Column:
    parts = F.filter(F.split(col(x), "\n\n+"), lambda p: (trimmed(p) != "") & ~trimmed(p).startswith("#"))
    return F.coalesce(F.right(F.get(parts, F.size(parts) - 1), F.lit(500)), F.lit(""))


def base64_text(x) -> Column:
    """Base64 of a text's UTF-8 bytes, on one line."""
    return F.replace(F.base64(F.encode(col(x), "UTF-8")), F.lit("\r\n"), F.lit(""))
