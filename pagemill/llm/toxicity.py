"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed rows for the word and for its leading
bytes (so that unseen forms of known stems have neighbours).  Filters of several
widths run over the words of the whole text, are rectified and max-pooled, and a
logistic layer scores them.  Thresholds are calibrated for each language on a part
of the sample that training does not see; the language is told from the text's
stop words, never from a column.  A score of 0.5 is the threshold of its language.

Defined cases: a null or empty text pools to zeros and gets a score; labels other
than 0 and 1 are not learned from; without rows of both classes all scores are the
rate of the positive class; repeated rows count as often as they occur; an empty
table gives an empty one; other columns stay, but for one of the score's name, which is
replaced; equal texts get equal scores; a row with a null id is scored and never learned
from (its held_out is null in the query).  A very long text is worked on whole: it
takes about 50 times its bytes of memory, other texts a MB at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagemill.llm.common import among, buffer_of, labelled_sample, slices, stop_hashes, word_bounds, word_hashes

PREFIXES = (0, 4, 5)  #: whole words, and their first 4 and 5 bytes
LANGUAGES = ("none", *sorted(stop_hashes()))
_STOPS = stop_hashes()


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 15
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    steps: int = 300  #: at least, whatever the epochs
    least_docs: int = 3  #: training texts that a bucket must occur in to have an embedding
    batch: int = 32
    rate: float = 0.01
    least: int = 8  #: positives that a language needs for a threshold of its own


def encode(column, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x prefixes) bucket numbers, n+1 word offsets, and each row's language number."""
    buf, offsets = buffer_of(column)
    starts, ends, first = word_bounds(buf, offsets)
    n = len(offsets) - 1
    ids = np.zeros((len(starts), len(PREFIXES)), np.int32)
    row = np.repeat(np.arange(n), np.diff(first))
    votes = np.zeros((n, len(LANGUAGES)))
    votes[:, 0] = 0.5
    for k, size in enumerate(PREFIXES):
        h = word_hashes(buf, starts, ends, size)
        ids[:, k] = h % np.uint64(buckets)
        if not size:
            for j, lang in enumerate(LANGUAGES[1:], 1):
                votes[:, j] = np.bincount(row[among(h, _STOPS[lang])], minlength=n)
    return ids, first, votes.argmax(1)


class Net:
    def __init__(self, shape: Shape, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.shape = shape
        self.e = rng.normal(0, 0.3, (shape.buckets, shape.dim)).astype(np.float32)
        self.w = [rng.normal(0, (w * shape.dim) ** -0.5, (w * shape.dim, shape.filters)).astype(np.float32) for w in shape.widths]
        self.b = [np.zeros(shape.filters, np.float32) for _ in shape.widths]
        self.v = rng.normal(0, 0.3, len(shape.widths) * shape.filters).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.shift = dict.fromkeys(range(len(LANGUAGES)), 0.0)

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        """(rows, filters) maxima, and the word at which each begins (-1: none)."""
        n, f = len(first) - 1, self.shape.filters
        out = np.zeros((n, f * len(self.shape.widths)), np.float32)
        best = np.full(out.shape, -1, np.int64)
        if not len(ids):
            return out, best
        x = self.e[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.e[ids[:, k]]
        full = np.flatnonzero(np.diff(first))
        for k, width in enumerate(self.shape.widths):
            w = self.w[k].reshape(width, self.shape.dim, f)
            y = x @ w[0]
            for j in range(1, width):  # words beyond the end of a text count as zeros
                z = x[j:] @ w[j]
                over = (first[1:][full, None] - 1 - np.arange(j)).ravel()
                over = over[(over >= 0) & (over < len(z))]
                z[over] = 0
                y[:-j] += z
            y += self.b[k]
            top = np.maximum.reduceat(y, first[full], axis=0)
            out[full, k * f : (k + 1) * f] = np.maximum(top, 0)
            if where:
                row = np.repeat(np.arange(len(full)), np.diff(first)[full])
                for i in range(f):
                    hit = np.flatnonzero((y[:, i] == top[row, i]) & (y[:, i] > 0))
                    r, at = np.unique(row[hit], return_index=True)
                    best[full[r], k * f + i] = hit[at]
        return out, best

    def logit(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0] @ self.v + self.c[0]

    def score(self, column) -> np.ndarray:
        ids, first, lang = encode(column, self.shape.buckets)
        z = self.logit(ids, first).astype(float) - np.array([self.shift[k] for k in range(len(LANGUAGES))])[lang]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: list[tuple[np.ndarray, int, int]], shape: Shape = Shape(), seed: int = 7) -> Net:
    """docs: (ids, language, label) of each training text."""
    net, rng = Net(shape, seed), np.random.Generator(np.random.PCG64(seed + 1))
    labels = np.array([d[2] for d in docs], np.float32)
    positive = float(labels.sum())
    net.c[0] = np.log((positive + 1) / (len(docs) - positive + 1))
    if not 0 < positive < len(docs):
        net.v[:] = 0
        return net
    order = rng.permutation(len(docs))
    held, train = order[: len(docs) // 5], order[len(docs) // 5 :]
    weight = np.where(labels > 0, min(4.0, (len(docs) - positive) / positive), 1.0).astype(np.float32)
    often = np.zeros(shape.buckets, np.int64)
    for i in train:
        often[np.unique(docs[i][0])] += 1
    rare = often < shape.least_docs  # these would only let it learn texts by heart
    net.e[rare] = 0
    parts = [net.v, net.c, *net.w, *net.b]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    seen = np.zeros(shape.buckets, np.float32)
    step = 0
    epochs = max(shape.epochs, -(-shape.steps * shape.batch // len(train)))
    for epoch in range(epochs):
        rng.shuffle(train)
        rate = shape.rate * (1 - epoch / (epochs + 1))
        for at in range(0, len(train), shape.batch):
            own = train[at : at + shape.batch]
            ids = np.concatenate([docs[i][0] for i in own])
            first = np.cumsum([0, *(len(docs[i][0]) for i in own)])
            p, best = net.pooled(ids, first, where=True)
            z = p @ net.v + net.c[0]
            d = (1 / (1 + np.exp(-z)) - labels[own]) * weight[own] / len(own)
            grads = [p.T @ d, np.array([d.sum()])]
            back = d[:, None] * net.v[None, :] * (best >= 0)
            wg, bg = [np.zeros_like(w) for w in net.w], [np.zeros_like(b) for b in net.b]
            eg: list[tuple[np.ndarray, np.ndarray]] = []
            f, dim = shape.filters, shape.dim
            for k, width in enumerate(shape.widths):
                r, i = np.nonzero(best[:, k * f : (k + 1) * f] >= 0)
                start, g = best[r, k * f + i], back[r, k * f + i]
                np.add.at(bg[k], i, g)
                for j in range(width):
                    at_word = start + j
                    ok = at_word < first[r + 1]
                    rows, gi, ii = ids[at_word[ok]], g[ok], i[ok]
                    x = net.e[rows].sum(1)
                    np.add.at(wg[k].T[:, j * dim : (j + 1) * dim], ii, gi[:, None] * x)
                    de = gi[:, None] * net.w[k][j * dim : (j + 1) * dim, ii].T
                    eg += [(rows[:, c], de) for c in range(rows.shape[1])]
            step += 1
            for q, g, (m, v) in zip(parts, [*grads, *wg, *bg], moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if eg:  # sparse rows, each with its own step size
                rows, inverse = np.unique(np.concatenate([r for r, _ in eg]), return_inverse=True)
                kept = ~rare[rows]
                g = np.zeros((len(rows), dim), np.float32)
                np.add.at(g, inverse, np.concatenate([x for _, x in eg]))
                rows, g = rows[kept], g[kept]
                seen[rows] += (g * g).mean(1)
                net.e[rows] -= 5 * rate * g / (np.sqrt(seen[rows])[:, None] + 1e-6)
    if len(held):
        logits = np.array([net.logit(docs[i][0], np.array([0, len(docs[i][0])]))[0] for i in held])
        lang, truth = np.array([docs[i][1] for i in held]), labels[held] > 0

        def threshold(z, t):
            z, order = np.sort(z)[::-1], np.argsort(-z)
            hits = np.cumsum(t[order])
            f1 = 2 * hits / (np.arange(1, len(z) + 1) + t.sum())
            k = int(f1.argmax())
            return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2)

        common = threshold(logits, truth) if truth.any() else 0.0
        net.shift = {k: threshold(logits[lang == k], truth[lang == k]) if truth[lang == k].sum() >= shape.least else common for k in net.shift}
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 6_000, max_bytes: int = 256 << 20, shape: Shape = Shape()) -> Net:
    """A net of at most max_rows labelled rows whose crc32(doc_id) mod 5 is not 0; their bucket numbers, whole rows of
    max_bytes in all, come to the driver.  A row of more than a 64th of that is left out, alone."""
    sample = labelled_sample(labels, label, max_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")  # max_rows rows at most

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                ids, first, lang = encode(b.column("text"), shape.buckets)
                raw = [ids[first[i] : first[i + 1]].astype("<i4").tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array(lang, pa.int32()), pa.array(raw, pa.binary())], ["label", "lang", "ids"])

    order = [F.col("h"), F.col("ids"), F.col("label")]
    found = joined.mapInArrow(run, "label int, lang int, ids binary").where(F.length("ids") <= max_bytes // 64).withColumn("h", F.xxhash64("ids", "label")).orderBy(*order).limit(max_rows)
    fits = found.withColumn("sum", F.sum(F.length("ids").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= max_bytes)
    rows = sorted((bytes(r[2]), r[1], r[0]) for r in fits.select("label", "lang", "ids").collect())  # the same net in any order of rows
    return fit([(np.frombuffer(x, "<i4").reshape(-1, len(PREFIXES)), lang, y) for x, lang, y in rows], shape)


def score(docs: DataFrame, net: Net, name: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    fields = [f for f in docs.schema.fields if f.name != name]
    kept = [f.name for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of the size that Shape gives

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(shared.value.score(b.column("text")), pa.float64())], [*kept, name])

    return docs.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))
