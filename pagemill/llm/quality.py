"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned; cyclic boosting of shallow trees, one
feature after the other, learns a lookup table for each feature, and then one for
each of a few feature pairs whose joint histogram explains most of what is left.
A score is the sigmoid of a sum of table entries: one vectorised gather and
addition for each table.

Defined cases: a null or empty text has zero in all features and gets a score;
null or other labels are not learned from; without labelled rows of both classes
all scores are the prior's; repeated rows count as often as they occur; an empty
table gives an empty one; other columns stay, but for one of the score's name, which
is replaced; equal texts get equal scores; a row with a null id is scored and never
learned from (its held_out is null in the query).  A very long text is worked on
whole: it takes about 60 times its bytes of memory, other texts a MB at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, SEPARATOR, among, buffer_of, labelled_sample, row_sums, slices, stop_hashes, word_bounds, word_hashes

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "digits", "symbols", "pipes", "upper", "wide", "lines",
    "distinct_words", "distinct_pairs", "stop_words", "marked_words", "loud_words", "repeated_lines", "longest_word", "ends",
)

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 symbol, 4 pipe, 5 other punctuation, 6 beyond ASCII, 7 separator
_KIND[33:127] = 5
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[ord(c) for c in "*#&%$@~^=<>{}[]\\_+"]] = 3
_KIND[ord("|")] = 4
_KIND[128:] = 6
_KIND[SEPARATOR] = 7
_STOP = np.sort(np.concatenate(list(stop_hashes().values())))


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct values of each row; n is at most 2**16 (see slices)."""
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=n)


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets)).astype(float)


def features_of(column) -> np.ndarray:
    """(rows, features) of a string column."""
    buf, offsets = buffer_of(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(FEATURES)))
    if not len(buf):
        return out
    kind = _KIND[buf]
    share = lambda mask: _counts(mask, offsets) / np.maximum(size, 1)
    starts, ends, first = word_bounds(buf, offsets)
    words = np.diff(first).astype(float)
    many = np.maximum(words, 1)
    row = np.repeat(np.arange(n), np.diff(first))
    hashes, length = word_hashes(buf, starts, ends), ends - starts
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2] = row_sums(length, first) / many
    for k, code in ((3, 1), (4, 2), (5, 3), (6, 4), (8, 6)):
        out[:, k] = share(kind == code)
    upper = (buf >= 65) & (buf < 91)
    out[:, 7] = share(upper)
    newline = buf == 10
    out[:, 9] = (_counts(newline, offsets) + 1) / many
    out[:, 10] = _distinct(row, hashes, n) / many
    if len(hashes) > 1:
        pair = (hashes[:-1] * np.uint64(3)) ^ hashes[1:]
        same = row[:-1] == row[1:]
        out[:, 11] = _distinct(row[:-1][same], pair[same], n) / np.maximum(words - 1, 1)
    out[:, 12] = row_sums(among(hashes, _STOP).astype(np.int32), first) / many
    if len(starts):
        last = _KIND[buf[ends - 1]]
        out[:, 13] = row_sums(((last == 3) | (last == 4) | (buf[ends - 1] == 33)).astype(np.int32), first) / many
        out[:, 14] = row_sums(((buf[starts] >= 65) & (buf[starts] < 91) & (length > 1) & (LOWER[buf[ends - 1]] != buf[ends - 1])).astype(np.int32), first) / many
        out[:, 16] = np.log1p(row_sums(length, first, np.maximum))
        out[:, 17] = np.where(words > 0, _KIND[buf[np.maximum(offsets[1:] - 1, 0)]] == 5, 0)
    begin = np.zeros(len(buf), bool)
    begin[1:] = newline[:-1]
    begin[offsets[:-1][offsets[:-1] < len(buf)]] = True
    at = np.flatnonzero(begin & ~newline)
    if len(at):
        closing = newline.copy()
        closing[offsets[1:][offsets[1:] > 0] - 1] = True
        stop = np.flatnonzero(closing)
        to = stop[np.searchsorted(stop, at)]
        of = np.searchsorted(offsets, at, "right") - 1
        lines = np.bincount(of, minlength=n)
        out[:, 15] = 1 - _distinct(of, word_hashes(buf, at, np.where(newline[to], to, to + 1)), n) / np.maximum(lines, 1)
        out[lines == 0, 15] = 0
    return out


@dataclass
class Model:
    prior: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        if self.edges:
            bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
            for b, t in zip(bins, self.tables, strict=True):
                margin += t[b]
            for i, j, t in self.pairs:
                margin += t[bins[i], bins[j]]
        return 1 / (1 + np.exp(-margin))


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram: left are the bins up to the place."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
    gain[(hl < 1) | (hr < 1)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k


def _step(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Leaf values, bin by bin, of a tree with at most three leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        gain, k, part = max((*_best_cut(g[a:b], h[a:b], l2), (a, b)) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], part[0] + k + 1), (part[0] + k + 1, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.08, l2: float = 1.0) -> Model:
    positive = float(y.sum())
    model = Model(float(np.log((positive + 1) / (len(y) - positive + 1))))
    if not 0 < positive < len(y):
        return model
    model.edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.prior)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, s, t in zip(at, sizes, model.tables, strict=True):
            g, h = slopes()
            step = rate * _step(np.bincount(b, g, s), np.bincount(b, h, s), l2)
            t += step
            margin += step[b]
    g, h = slopes()
    ranked = []
    for i in range(len(sizes)):
        for j in range(i):
            gij = np.bincount(at[i] * sizes[j] + at[j], g, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
            hij = np.bincount(at[i] * sizes[j] + at[j], h, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
            _, k = _best_cut(gij.sum(1), hij.sum(1), l2)
            ranked.append((sum(_best_cut(gij[part].sum(0), hij[part].sum(0), l2)[0] for part in (slice(0, k + 1), slice(k + 1, None))), i, j))
    for _, i, j in sorted(ranked, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros((sizes[i], sizes[j]))))
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            flat = at[i] * sizes[j] + at[j]
            gij, hij = (np.bincount(flat, v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for v in (g, h))
            _, k = _best_cut(gij.sum(1), hij.sum(1), l2)
            step = np.zeros_like(t)
            for part in (slice(0, k + 1), slice(k + 1, None)):
                step[part] = _step(gij[part].sum(0), hij[part].sum(0), l2)[None, :]
            t += rate * step
            margin += rate * step[at[i], at[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **options) -> Model:
    """A model of at most max_rows labelled rows whose crc32(doc_id) mod 5 is not 0; of the join, only their features come to the driver."""
    sample = labelled_sample(labels, label, max_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")  # max_rows rows at most

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                x = features_of(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    # Ids may repeat in docs: again max_rows at most.
    rows = joined.mapInArrow(run, "label int, x array<double>").orderBy(F.xxhash64("x", "label"), "x", "label").limit(max_rows).collect()
    rows = sorted(((r[0], tuple(r[1])) for r in rows), key=lambda r: (r[1], r[0]))  # the same model in any order of rows
    return fit(np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r[0]) for r in rows]), **options)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    fields = [f for f in docs.schema.fields if f.name != name]
    kept = [f.name for f in fields]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model.score(features_of(b.column("text"))), pa.float64())], [*kept, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))
