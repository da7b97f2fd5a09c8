"""Phrase collocation mining by suffix-sigma.

Texts are split at punctuation and line ends into pieces and those into words.  From
every word on, the piece's next max_n words make a suffix; equal suffixes of some MB of
text are counted together and shuffled by language and first word.  Each partition is
sorted reverse-lexicographically, so that all suffixes with a common beginning stand
together, and one stack of max_n open prefixes counts all of them in one pass, over
Arrow batches.  The counts of a phrase's parts are joined afterwards.

Skew: a first word with more than 1/SHARES of all words is dealt out by the words that
follow it, into parts of about that share each; its longest phrases meet in one part,
and the counts of its shorter ones are added up over the parts.  Its own count is
broadcast to the phrases that begin or end with it (at most SHARES words, and together
at most SHARES times a mean word's bytes); other parts are joined by sort and merge.
Lists by language are ranked in salted groups first.

Defined cases: a null text is empty, a null language is ``und``; texts without words
give nothing, nor does an empty table; a phrase has at most max_n words; repeated rows
count each; ties in rank go by count, then by the phrase's bytes; only text and lang are
read, other columns whatever their names are ignored.  Texts are taken in slices of
two MB, a longer text as a whole, at about 150 bytes of memory a byte of text, as every
word begins a suffix of max_n words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, buffer_of, row_sums, slices, word_bounds, word_hashes, written

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = BREAK.copy()
BETWEEN[[0x20, 0x09]] = True
SHARES = 4096
SLICE = 1 << 21  #: bytes of text whose suffixes are counted together
PARTS = 2 * SHARES  #: more than the parts of any word
SALTS = 64  #: groups in which a language's phrases are ranked first


def _span_index(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _languages(batch, lang: str) -> pa.Array:
    column = batch.column(lang).cast(pa.string())
    return column.fill_null("und") if column.null_count else column


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, h, f): how often each word, told by its hash, occurs; only sums and skew are taken from it."""

    def count(batches):
        for whole in batches:
            for b in slices(whole, text, SLICE):
                buf, offsets = buffer_of(b.column(text))
                starts, ends, first = word_bounds(buf, offsets, BETWEEN)
                names = _languages(b, lang).dictionary_encode()
                code = np.repeat(names.indices.to_numpy(), np.diff(first))
                hashes = word_hashes(buf, starts, ends)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    h, f = np.unique(hashes[code == k], return_counts=True)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(f)], ["lang", "h", "f"])

    return docs.select(lang, text).mapInArrow(count, "lang string, h long, f long").groupBy("lang", "h").agg(F.sum("f").alias("f"))


def _named(lang: str) -> str:
    """A language as the beginning of a key, which a tab ends."""
    return lang.replace("\\", "\\s").replace("\t", "\\t") + "\t"


def _plain(key: str) -> tuple[str, str]:
    """Language and phrase of a key."""
    name, phrase = key.split("\t", 1)
    return name.replace("\\t", "\t").replace("\\s", "\\"), phrase.rstrip(" ")


def suffixes(docs: DataFrame, text: str, lang: str, max_n: int, hot: dict[tuple[str, int], int]) -> DataFrame:
    """(key, n): the counted suffixes.  key: the language, a tab, and the words, each followed by a space; n: PARTS
    times the count, plus 0 or, for a first word in hot, 1 plus the part that the suffix is dealt to.

    Rows of a slice come in rough order, which makes what is shuffled smaller.
    """
    known = {}  # by language: the hashes that are dealt out, sorted, and into how many parts
    for name, h in sorted(hot):
        known.setdefault(name, []).append((h, hot[name, h]))
    known = {name: (np.array([h for h, _ in v], np.int64), np.array([n for _, n in v], np.uint64)) for name, v in known.items()}

    def cut(batches):
        for whole in batches:
            for b in slices(whole, text, SLICE):
                buf, offsets = buffer_of(b.column(text))
                starts, ends, first = word_bounds(buf, offsets, BETWEEN)
                names = _languages(b, lang).dictionary_encode()
                code = names.indices.to_numpy()
                # How many words of its piece a suffix has: those before the next break, in the row.
                breaks = np.cumsum(BREAK[buf], dtype=np.int32)[starts]
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                last = np.flatnonzero(np.append((row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1]), True)) if len(starts) else starts
                depth = np.minimum(max_n, last[np.searchsorted(last, np.arange(len(starts)))] - np.arange(len(starts)) + 1)
                hashes = word_hashes(buf, starts, ends).view(np.int64)
                size = ends - starts
                packed = np.full(int((size + 1).sum()) + 8, 0x20, np.uint8)
                at = np.append(0, np.cumsum(size + 1))
                packed[_span_index(at[:-1], size)] = LOWER[buf[_span_index(starts, size)]]
                for k, name in enumerate(names.dictionary.to_pylist()):
                    mine = np.flatnonzero(code[row] == k)
                    begin = packed[at[mine][:, None] + np.arange(8)].view(">u8").ravel()
                    mine = mine[np.argsort(begin, kind="stable")]
                    length = at[mine + depth[mine]] - at[mine]
                    flat = packed[_span_index(at[mine], length)]
                    joined = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int64)), pa.py_buffer(flat))
                    got = pa.table({"suffix": joined, "h": hashes[mine]}).group_by(["suffix", "h"], use_threads=False).aggregate([([], "count_all")])
                    n = got["count_all"].to_numpy() * PARTS
                    if name in known:
                        of, into = known[name]
                        head = got["h"].to_numpy()
                        where = np.minimum(np.searchsorted(of, head), len(of) - 1)
                        near = np.flatnonzero(of[where] == head)
                        text_buf, text_at = buffer_of(got["suffix"])
                        size = np.diff(text_at)[near]
                        end = np.cumsum(size)
                        rest = word_hashes(text_buf[_span_index(text_at[near], size)], end - size, end)  # of the whole suffix
                        n[near] += 1 + (rest % into[where[near]]).astype(np.int64)
                    key = pa.compute.binary_join_element_wise(pa.scalar(_named(name), pa.large_string()), got["suffix"].combine_chunks(), pa.scalar("", pa.large_string()))
                    for lo in range(0, len(n), 1 << 16):
                        yield pa.RecordBatch.from_arrays([key[lo : lo + (1 << 16)].cast(pa.string()), pa.array(n[lo : lo + (1 << 16)])], ["key", "n"])

    return docs.select(lang, text).mapInArrow(cut, "key string, n long")


class Stack:
    """The open prefixes of a reverse-lexicographically sorted stream of suffixes, with their counts so far."""

    def __init__(self, max_n: int):
        self.max_n, self.top, self.split, self.counts = max_n, b"", False, [0] * max_n

    def push(self, text: np.ndarray, at: np.ndarray, c: np.ndarray):
        """Takes rows (keys text[at[i]:at[i+1]]; c occurrences); gives (row, words, count) of the prefixes that they
        close, row -1 for that of the rows before, and how far each row's first words go."""
        n = len(c)
        tabs = np.flatnonzero(text == 0x09)  # one in each key, as no word holds any
        spaces = np.flatnonzero(text == 0x20)
        first = np.searchsorted(spaces, tabs)  # a language may hold spaces
        words = np.searchsorted(spaces, at[1:]) - first
        end = np.zeros((self.max_n, n), np.int64)  # bytes of a row's first d+1 words
        for d in range(self.max_n):
            has = words > d
            end[d, has] = spaces[first[has] + d] + 1 - at[:-1][has]
        # Bytes that a row has in common with the one before it.
        before = np.append(len(self.top), np.diff(at)[:-1])
        least = np.minimum(before, np.diff(at))
        least[0] = 0
        same = text[_span_index(at[:-1], least)] == text[_span_index(np.append(0, at[:-2]), least)]
        bounds = np.append(0, np.cumsum(least))
        place = np.where(same, np.iinfo(np.int64).max, np.arange(len(same)) - np.repeat(bounds[:-1], least))
        common = np.minimum(row_sums(place, bounds, np.minimum, np.iinfo(np.int64).max), least)
        head = text[at[0] : at[1]].tobytes()
        k = 0
        while k < min(len(head), len(self.top)) and head[k] == self.top[k]:
            k += 1
        common[0] = k
        out = []
        for d in range(self.max_n):
            opens = (end[d] == 0) | (end[d] > common)  # the row begins another prefix of d+1 words than the one before
            if opens[0] and self.counts[d]:
                out.append((np.array([-1]), d + 1, np.array([self.counts[d]])))
                self.counts[d] = 0
            begin = np.flatnonzero(np.append(True, opens[1:]))
            total = np.add.reduceat(c, begin)
            total[0] += self.counts[d]
            holds = end[d, begin] > 0
            self.counts[d] = int(total[-1]) if holds[-1] else 0
            closed = np.flatnonzero(holds[:-1])
            out.append((begin[closed], d + 1, total[closed]))
        return out, end


def prefix_counts(rows: DataFrame, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, words, f, split) of sorted (key, n): all prefixes with f >= least, and of words that are dealt out all parts."""

    def run(batches):
        stack = Stack(max_n)
        names = ["lang", "phrase", "words", "f", "split"]

        def kept(count, split, d):
            return (count >= least) | (split & (d < max_n))

        def told(keys, d, count, split):
            both = [_plain(k) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.string()), pa.array(np.full(len(both), d, np.int32)), pa.array(count, pa.int64()), pa.array(split, pa.bool_())], names)

        def before(d, count):  # of the rows before, which the stack remembers
            if kept(count, stack.split, d):
                lang, words = stack.top.split(b"\t", 1)
                yield told([(lang + b"\t" + b" ".join(words.split(b" ")[:d])).decode()], d, [count], [stack.split])

        for b in batches:
            for lo in range(0, b.num_rows, 1 << 16):
                part = b.slice(lo, 1 << 16)
                n = part.column("n").to_numpy()
                split = n % PARTS > 0
                text, at = buffer_of(part.column("key"))
                closed, end = stack.push(text, at, n // PARTS)
                for row, d, count in closed:
                    if len(row) and row[0] < 0:
                        yield from before(d, int(count[0]))
                        continue
                    keep = kept(count, split[row], d)
                    row, count = row[keep], count[keep]
                    size = end[d - 1, row]
                    flat = text[_span_index(at[row], size)]
                    keys = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(flat))
                    yield told(keys.to_pylist(), d, count, split[row])
                stack.top, stack.split = text[at[-2] :].tobytes(), bool(split[-1])
        for d, count in enumerate(stack.counts):
            if count:
                yield from before(d + 1, count)

    return rows.mapInArrow(run, "lang string, phrase string, words int, f long, split boolean")


def _counted(rows: DataFrame, part: str, name: str, counts: DataFrame, often: DataFrame) -> DataFrame:
    """rows with the count of the phrase in part: of frequent words by broadcast, of all others by a join."""
    told = rows.join(F.broadcast(often.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))), ["lang", part], "left")
    rest = told.where(F.col(name).isNull()).drop(name).join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    return told.where(F.col(name).isNotNull()).unionByName(rest)


def _exact(*factors: Column) -> Column:
    """A product of counts below 10**12, as a decimal."""
    out = factors[0].cast("decimal(12,0)")
    for f in factors[1:]:
        out = out * f.cast("decimal(12,0)")
    return out


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, top: int = 2000, inside: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of 2 to max_n words of each language.

    a: occurrences of the phrase, at least least; l, r: of the two parts of the cut of
    least score; n: of all words; score: floor(10**6 a a / (l r)).  Phrases inside a
    longer one with at least inside per cent of their occurrences are left out.
    """
    seen = written(word_counts(docs, text, lang), "words")
    totals = seen.groupBy("lang").agg(F.sum("f").alias("n"))
    every = seen.agg(F.sum("f")).first()[0] or 0
    hot = {(r["lang"], r["h"]): int(-(-r["f"] * SHARES // every)) for r in seen.where(F.col("f") * SHARES > every).collect()}  # at most SHARES words
    dealt = suffixes(docs, text, lang, max_n, hot).repartition(F.substring_index(F.substring_index("key", "\t", -1), " ", 1), F.substring_index("key", "\t", 1), F.pmod("n", F.lit(PARTS)))
    found = written(prefix_counts(dealt.sortWithinPartitions(F.desc("key")), max_n, least), "prefixes")
    # Of a word that is dealt out, only the longest phrases are whole.
    whole = F.col("split") & (F.col("words") < max_n)
    added = found.where(whole).groupBy("lang", "phrase", "words", "split").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    counts = written(found.where(~whole).unionByName(added.select(found.columns)), "phrases")
    often = counts.where(F.col("split") & (F.col("words") == 1)).select("lang", "phrase", "f")
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "words", "a", k)
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = _counted(_counted(cuts, "left", "l", counts, often), "right", "r", counts, often)
    cuts = cuts.withColumn("over", _exact(F.lit(1_000_000), F.col("a"), F.col("a"))).withColumn("under", _exact(F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r", "a")).alias("best"))
    ends = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase")
    longer = phrases.where("words >= 3").select("lang", "a", ends).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("best.a") * inside))
    kept = kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", ranked("lang", "salt")).where(F.col("rank") <= top)
    out = first.withColumn("rank", ranked("lang")).where(F.col("rank") <= top).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
