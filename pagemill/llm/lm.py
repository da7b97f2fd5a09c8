"""LM scoring by a weighted backoff automaton over words.

State 0 holds all training tokens with absolutely discounted counts, what the
discount leaves being the probability of a token unseen in training.  Each word of
the training texts, and the begin of a text, is a further state: its arcs are the
discounted counts of all words (or the end) that follow it, to which the discounted
rest is added in proportion to state 0; its failure arc leads to state 0 with the
weight of that rest, so that all continuations sum to one.  A text is traversed once
from left to right: a token takes the arc of the current state or else fails to
state 0, and sets the next state.

Nothing of the vocabulary or of the word pairs is broadcast.  Texts are packed into
blocks of a few MB with their distinct words.  Each block asks for the counts of its
words, and then of its pairs, in one packed row for each bucket of their hashes; a
bucket answers all blocks, and the answers meet their block again.  So a word or
pair costs an entry for each block that has it, not for each occurrence.  Pairs go to
the bucket of their first word, which so sees all its followers; those of a hot word,
one that makes up more than 1 / HOT of the tokens or occurs HOT_MOST times, are spread
by both words, and the numbers of its followers are summed up.  So no bucket has more
than HOT_MOST entries of one first word, as long as there are no more than HOT_MOST *
HOT_WORDS tokens (some 100 TB of text).  Only the hot words' hashes and sums, of at most
HOT_WORDS words (64 MB) and the begin, go to all executors.

Defined cases: null texts count as empty and have the end as their one token; rows
with a null id are scored, not learned from, and have a null held_out; repeated
rows are scored each and learned from each; with nothing to learn from, every score
is 0 (the unseen token is sure); an empty table gives an empty one; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import among, buffer_of, crc_mod, mixed, row_sums, slices, word_bounds, word_hashes, written

BLOCK_BYTES = 6 << 20  #: of text in a block, but for a text that is longer
HOT, HOT_LEAST = 1 << 16, 1 << 14  #: pairs are spread by both words where the first is more than 1 / HOT of the tokens, and occurs HOT_LEAST times
HOT_MOST, HOT_WORDS = 1 << 22, 1 << 22  #: or where it occurs HOT_MOST times, however many tokens there are; but for at most HOT_WORDS words
EDGE = np.uint64(0x9D39247E33776D41)  #: stands for the begin before and the end after the words of a text

_PACKED = "block long, ids binary, valid binary, part binary, first binary, tokens binary, hashes binary, counts binary"


def _zip(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, kind).tobytes())


def _unzip(x, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(x)), kind)


def _pack(batches):
    """Blocks of texts; part is crc32(id) mod 5."""

    def block(parts):
        ids, valid, part = (np.concatenate([p[k] for p in parts]) for k in range(3))
        first = np.cumsum(np.concatenate([[0], *(np.diff(p[3]) for p in parts)]))
        hashes = np.concatenate([p[4] for p in parts])
        known, token, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # small numbers for frequent words pack well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        token, known = rank[token], known[order]
        learned = np.isin(part, (0, 2, 3, 4))
        row = np.repeat(np.arange(len(ids)), np.diff(first))
        use = learned[row]
        counts = np.bincount(token[use], minlength=len(known))
        values = [[uuid.uuid4().int >> 65], *([_zip(x, k)] for x, k in ((ids, "<i8"), (valid, "u1"), (part, "i1"), (first, "<i8"), (token, "<i4"), (known, "<u8"), (counts, "<i8")))]
        names = [c.split()[0] for c in _PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), *(pa.array(v, pa.binary()) for v in values[1:])], names)

    parts, held = [], 0
    for whole in batches:
        for b in slices(whole, "text"):
            buf, offsets = buffer_of(b.column("text"))
            starts, ends, first = word_bounds(buf, offsets)
            ids = b.column("doc_id")
            valid = np.array(ids.is_valid())
            parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), valid, b.column("part").fill_null(-1).to_numpy(zero_copy_only=False), first, word_hashes(buf, starts, ends)))
            held += len(buf)
            if held >= BLOCK_BYTES:
                yield block(parts)
                parts, held = [], 0
    if parts:
        yield block(parts)


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes that hold all of them; the length tells how many."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes() if len(x) else b""


def _numbers(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def _word_asks(buckets: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                hashes, counts = _unzip(b.column("hashes")[i].as_py(), "<u8"), _unzip(b.column("counts")[i].as_py(), "<i8")
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order]
                bucket = _bucket(hashes, buckets)
                cuts = _cuts(bucket)
                if len(cuts) > 1:
                    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    keys, n = (pa.array([f(x[i:j]) for i, j in spans], pa.binary()) for f, x in ((np.ndarray.tobytes, hashes), (_small, counts)))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(spans), b.column("block")[i].as_py())), keys, n], ["bucket", "block", "keys", "n"])

    return run


_ANSWERS = "block long, bucket int, pairs boolean, totals binary, follows binary, key long, n long, types long, ones long, twos long"


def _answer(blocks, bucket, pairs, totals, follows, keys, counts, sums) -> pa.Table:
    """Answers to blocks, numbers of keys, and the sums of the bucket."""
    m, h = len(blocks), len(keys)
    return pa.table(
        {
            "block": pa.array([*blocks, *[None] * (h + 1)], pa.int64()),
            "bucket": pa.array([bucket] * (m + h + 1), pa.int32()),
            "pairs": pa.array([pairs] * (m + h + 1)),
            "totals": pa.array([*totals, *[None] * (h + 1)], pa.binary()),
            "follows": pa.array([*follows, *[None] * (h + 1)], pa.binary()),
            "key": pa.array([*[None] * m, *keys, None], pa.int64()),
            "n": pa.array([*[None] * m, *counts, sums[0]], pa.int64()),
            **{c: pa.array([*[None] * (m + h), x], pa.int64()) for c, x in zip(("types", "ones", "twos"), sums[1:], strict=True)},
        }
    )


def _sums(total: np.ndarray) -> list[int]:
    return [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]


def _word_answers(asks: pa.Table) -> pa.Table:
    """The training counts of each block's words; as keys the words that may be hot."""
    parts = [np.frombuffer(x, "<u8") for x in asks["keys"].to_pylist()]
    known, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.concatenate([_numbers(x, len(p)) for x, p in zip(asks["n"].to_pylist(), parts, strict=True)])
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, n)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    often = total > HOT_LEAST
    return _answer(asks["block"].to_pylist(), asks["bucket"][0].as_py(), False, [_small(x) for x in np.split(total[at], cuts)], [None] * len(parts), known[often].view(np.int64).tolist(), total[often].tolist(), _sums(total))


def _pairs(hashes: np.ndarray, token: np.ndarray, first: np.ndarray, buckets: int, hot: np.ndarray):
    """The walk through all texts, an end after each, and its distinct pairs.

    By step: row, number of the word and of the one before (len(hashes): end and begin), and of the pair.
    By pair, sorted by bucket, first and second word: bucket and both words' hashes.
    """
    k, rows = len(hashes), len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first) + 1)
    end = np.zeros(len(row), bool)
    end[first[1:] + np.arange(rows)] = True
    now = np.full(len(row), k)
    now[~end] = token
    was = np.roll(now, 1)
    was[first[:-1] + np.arange(rows)] = k
    pair, at = np.unique(was * (k + 1) + now, return_inverse=True)
    keys = np.append(hashes, EDGE)
    u, w = keys[pair // (k + 1)], keys[pair % (k + 1)]
    bucket = _bucket(np.where(among(u, hot), mixed(u ^ (w * np.uint64(0x9E3779B97F4A7C15))), u), buckets)
    order = np.lexsort((w, u, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return row, now, was, rank[at], bucket[order], u[order], w[order]


def _runs(bucket: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The number of each pair's run of the same bucket and first word."""
    new = np.zeros(len(u), np.int64)
    new[1:] = (u[1:] != u[:-1]) | (bucket[1:] != bucket[:-1])
    return np.cumsum(new)


def _pair_asks(buckets: int, shared):
    def run(batches):
        hot = shared.value
        for b in batches:
            for i in range(b.num_rows):
                got = {c: b.column(c)[i].as_py() for c in ("block", "hashes", "tokens", "first", "part")}
                row, _, _, at, bucket, u, w = _pairs(_unzip(got["hashes"], "<u8"), _unzip(got["tokens"], "<i4"), _unzip(got["first"], "<i8"), buckets, hot)
                learned = np.isin(_unzip(got["part"], "i1"), (0, 2, 3, 4))
                n = np.bincount(at[learned[row]], minlength=len(u))
                rows = []
                cuts = _cuts(bucket)
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    runs = _cuts(u[x:y])
                    rows.append((int(bucket[x]), got["block"], u[x:y][runs[:-1]].tobytes(), _small(np.diff(runs)), w[x:y].tobytes(), _small(n[x:y])))
                if rows:
                    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "u", "per", "w", "n"])

    return run


def _pair_answers(shared):
    """For each block: the training counts of its pairs, and for each of their first words the number of words that follow it in this bucket; as keys the hot first words."""

    def run(asks: pa.Table) -> pa.Table:
        us = [np.frombuffer(x, "<u8") for x in asks["u"].to_pylist()]
        ws = [np.frombuffer(x, "<u8") for x in asks["w"].to_pylist()]
        per = np.concatenate([_numbers(x, len(u)) for x, u in zip(asks["per"].to_pylist(), us, strict=True)])
        n = np.concatenate([_numbers(x, len(w)) for x, w in zip(asks["n"].to_pylist(), ws, strict=True)])
        firsts, which = np.unique(np.concatenate(us), return_inverse=True)
        u, w = np.repeat(which, per), np.concatenate(ws)
        order = np.lexsort((w, u))
        new = np.append(True, (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1]))
        begin = np.flatnonzero(new)
        total = np.add.reduceat(n[order], begin)
        each = np.empty(len(u), np.int64)
        each[order] = total[np.cumsum(new) - 1]
        follows = np.bincount(u[order][begin][total > 0], minlength=len(firsts))
        hot = among(firsts, shared.value)
        totals = np.split(each, np.cumsum([len(x) for x in ws])[:-1])
        own = np.split(follows[which], np.cumsum([len(x) for x in us])[:-1])
        return _answer(asks["block"].to_pylist(), asks["bucket"][0].as_py(), True, map(_small, totals), map(_small, own), firsts[hot].view(np.int64).tolist(), follows[hot].tolist(), _sums(total))

    return run


def _arcs(count, total, left, unigram, discount: float):
    """Probability of continuations of a state: its discounted count, and of what is left the unigram's share."""
    return np.maximum(count - discount, 0) / np.maximum(total, 1) + left * unigram


def automaton(pairs: np.ndarray, unigram: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 arc weights (nan: none) and log10 failure weights by state, of a model that is small enough for a table.

    pairs: counts of (state, word or end); all continuations of a state, listed or not, are in its last column.
    unigram: probabilities of the words and the end.
    """
    count, total = pairs[:, :-1], pairs[:, -1:]
    left = 1 - _arcs(count, total, 0, unigram, discount).sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.where(count > 0, np.log10(_arcs(count, total, left, unigram, discount)), np.nan), np.log10(left[:, 0])


def hot_from(tokens: int) -> float:
    """A word that occurs more often is hot, if it occurs HOT_LEAST times: so fewer than HOT_WORDS words are."""
    return max(min(tokens / HOT, HOT_MOST), tokens / HOT_WORDS)


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if 0 < ones and 0 < twos else 0.5


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows whose crc32(id) mod 5 is held are not learned from."""
    spark = docs.sparkSession
    shifted = (crc_mod("doc_id") + (6 - held)) % 5  # _pack leaves out part 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("part", shifted.cast("int"))
    blocks = written(rows.mapInArrow(_pack, _PACKED), "blocks")
    buckets = 1024 * (1 + blocks.count() // 8192)  # a few million entries each
    seen = [F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col(c))), F.lit(0)) for c in ("n", "types", "ones", "twos")]

    asks = blocks.select("block", "hashes", "counts").mapInArrow(_word_asks(buckets), "bucket int, block long, keys binary, n binary")
    words = written(asks.groupBy("bucket").applyInArrow(_word_answers, _ANSWERS), "words")
    ends = rows.agg(F.count_if(F.col("part") != 1)).first()[0]
    tokens, types, ones, twos = words.where("block IS NULL").agg(*seen).first()
    n, v, discount = tokens + ends, types + (ends > 0), _discount(ones, twos)
    often = words.where(F.col("key").isNotNull() & (F.col("n") > hot_from(n))).select("key").toArrow()  # less than HOT_WORDS rows
    hot = np.sort(np.append(often["key"].to_numpy().astype(np.int64).view(np.uint64), EDGE))
    shared = spark.sparkContext.broadcast(hot)

    asks = blocks.select("block", "part", "first", "tokens", "hashes").mapInArrow(_pair_asks(buckets, shared), "bucket int, block long, u binary, per binary, w binary, n binary")
    pairs = written(asks.groupBy("bucket").applyInArrow(_pair_answers(shared), _ANSWERS), "pairs")
    _, _, ones, twos = pairs.where("block IS NULL").agg(*seen).first()
    pair_discount = _discount(ones, twos)
    follow = pairs.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most as many as hot
    of_hot = np.zeros(len(hot), np.int64)
    of_hot[np.searchsorted(hot, follow["key"].to_numpy().astype(np.int64).view(np.uint64))] = follow["n"].to_numpy()
    hot_follows = spark.sparkContext.broadcast(of_hot)

    def finish(_, block: pa.Table, answer: pa.Table) -> pa.Table:
        got = {c: block[c][0].as_py() for c in block.column_names}
        token, part = _unzip(got["tokens"], "<i4"), _unzip(got["part"], "i1")
        hashes, first, hot = _unzip(got["hashes"], "<u8"), _unzip(got["first"], "<i8"), shared.value
        row, now, was, at, bucket, u, _ = _pairs(hashes, token, first, buckets, hot)
        run = _runs(bucket, u)

        def told(kind: bool, of: np.ndarray, column: str) -> np.ndarray:
            """The numbers of all buckets, where of is the sorted entries' buckets."""
            size = np.bincount(of, minlength=buckets)
            parts = sorted((b, x) for b, k, x in zip(answer["bucket"].to_pylist(), answer["pairs"].to_pylist(), answer[column].to_pylist(), strict=True) if k == kind)
            return np.concatenate([np.zeros(0, np.int64), *(_numbers(x, int(size[b])) for b, x in parts)])

        order = np.argsort(hashes)
        total = np.full(len(hashes) + 1, ends)
        total[order] = told(False, _bucket(hashes[order], buckets), "totals")
        count, before = total[now], total[was]
        starts = _cuts(run)[:-1]
        follows = told(True, bucket[starts], "follows")
        often = among(u[starts], hot)
        follows[often] = hot_follows.value[np.searchsorted(hot, u[starts][often])]
        bounds = first + np.arange(len(first))
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        if n:
            p = np.where(count > 0, count - discount, discount * v) / n
            left = np.where(before > 0, pair_discount * follows[run[at]] / np.maximum(before, 1), 1)
            own = np.log10(_arcs(told(True, bucket, "totals")[at], before, left, p, pair_discount))
        else:
            own = np.zeros(len(row))
        return pa.table(
            {
                "doc_id": pa.array(_unzip(got["ids"], "<i8"), mask=_unzip(got["valid"], "u1") == 0),
                "held_out": pa.array(part == 1, mask=part < 0),
                "n_tokens": np.diff(bounds),
                "n_known": row_sums((count > 0).astype(np.int64), bounds),
                "train_tokens": np.full(len(part), n, np.int64),
                "base_score": row_sums(base, bounds, empty=0.0),
                "score": row_sums(own, bounds, empty=0.0),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = words.unionAll(pairs).where("block IS NOT NULL").select("block", "bucket", "pairs", "totals", "follows")
    return blocks.drop("counts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
