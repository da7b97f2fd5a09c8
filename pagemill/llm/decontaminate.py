"""Benchmark decontamination: CGK random walks, bit-sampling LSH and exact edit distances.

Texts and benchmark items become sequences of words (runs of letters, digits and
bytes beyond ASCII, lower-cased).  A CGK walk reads a window word by word,
stays or steps on by a random bit of the word read, and so embeds edit distance
into Hamming distance.  A repetition samples a few steps of the walk; a window
whose sampled words equal those of an item's window is a candidate.  Windows are
about as long as the item (its size class), start at every ``stride`` words of a
text and at every word of an item, so that each passage has a window that is
aligned.  Walks end early once their sampled words fit no item.  The number of
repetitions is what reaches TARGET on the items themselves with as many simulated
edits as count as a match, for each kind of edits.
Candidates are verified by the exact edit distance, in words, of the whole item to
the nearest passage around the window.

The items go to all executors in blocks of at most ``block_bytes`` of text; a larger
benchmark takes one pass over the texts for each block.

Defined cases: null and empty texts match nothing; items without words are left
out; equal items are reported each; rows that repeat an id are scanned each and
reported once an item; rows with a null id are scanned and reported with a null id;
``decontaminated`` judges each row alone, whatever its id; a very long text is worked
on whole, in memory of about 30 times its bytes; empty tables give an empty result;
other columns are ignored by ``matches`` and stay in ``decontaminated``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import buffer_of, slices, word_bounds, word_hashes

GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
SAMPLED = 6  #: steps sampled by a repetition
TARGET = 0.95  #: recall to reach where MAX_EDIT of an item's words are edited, of each kind of edits
KINDS = 4  #: of edits: words go, others stand for them, words come, and all of these
MAX_EDIT = 0.2  #: edit distance at most, as a share of the item's words
BITS = 16
BLOCK_BYTES = 4 << 20  #: of the items' texts that go to all executors at a time; with their repetitions about thirty times as many


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and n+1 offsets."""
    buf, offsets = buffer_of(pc.utf8_lower(column))
    starts, ends, first = word_bounds(buf, offsets, GAP)
    return word_hashes(buf, starts, ends), first


def size_class(n: int) -> tuple[int, int]:
    """Window length and stride for items of n words: the longest of 1, 2, 3, 4, 6, 8, 12, 16, ... that leaves room for all alignments."""
    best, size = (1, 1), 1
    while size <= n:
        for long in {size, size * 3 // 2}:
            if long + max(1, long // 2) - 1 <= n and long > best[0]:
                best = (long, max(1, long // 2))
        size *= 2
    return best


@dataclass
class Repetition:
    """One walk for one size class: odd multipliers that give each step's bits, the sampled steps, and what item windows have there."""

    long: int
    stride: int
    turns: np.ndarray
    steps: np.ndarray
    maps: list[np.ndarray]  # by sampled step: which partial keys items have, by their upper BITS
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (key ^ word) * np.uint64(0x9E3779B97F4A7C15) + (key >> np.uint64(29))


def _walk(words: np.ndarray, at: np.ndarray, stop: np.ndarray, turns: np.ndarray, steps: np.ndarray, maps: list | None):
    """Keys of the walks that start at the positions, and which walks are left; they read 0 from their stop on."""
    live, key = np.arange(len(at)), np.zeros(len(at), np.uint64)
    partial, wanted = [], dict(zip(steps.tolist(), range(len(steps)), strict=True))
    for j in range(int(steps[-1]) + 1):
        word = np.where(at < stop, words[at], np.uint64(0))
        if j in wanted:
            key = _mix(key, word)
            if maps is None:
                partial.append(key)
            else:
                ok = maps[wanted[j]][(key >> np.uint64(64 - BITS)).astype(np.int64)]
                live, key, at, stop, word = live[ok], key[ok], at[ok], stop[ok], word[ok]
                if not len(live):
                    break
        at = np.minimum(at + ((word * turns[j]) >> np.uint64(63)).astype(np.int64), stop)
    return live, key, partial


def _closed(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a 0 after each row, and the rows' offsets therein."""
    begin = first + np.arange(len(first))
    out = np.zeros(begin[-1], np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = words
    return out, begin


def repetitions(items: list[np.ndarray], target: float = TARGET, edits: float = MAX_EDIT, most: int = 1000, seed: int = 3) -> list[Repetition]:
    rng = np.random.Generator(np.random.PCG64(seed))
    groups: dict[tuple[int, int], list[int]] = {}
    for i, w in enumerate(items):
        if len(w):
            groups.setdefault(size_class(len(w)), []).append(i)
    out = []
    for (long, stride), own in sorted(groups.items()):
        words, begin = _closed(np.concatenate([items[i] for i in own]), np.cumsum([0, *(len(items[i]) for i in own)]))
        place = [np.arange(len(items[i]) - long + 1) for i in own]
        at = np.concatenate([begin[k] + p for k, p in enumerate(place)])
        item = np.repeat(np.array(own), [len(p) for p in place])
        where = np.concatenate(place)
        # Edited items, whose recall tells how many repetitions are needed.
        probe = []
        for k, i in enumerate(own[k] for k in rng.integers(0, len(own), 480)):
            w = items[i]
            hit = np.isin(np.arange(len(w)), rng.choice(len(w), int(edits * len(w)), replace=False))
            kind = rng.integers(0, 3, len(w)) if k % KINDS == 3 else np.full(len(w), k % KINDS)
            new = rng.integers(1, 2**62, len(w)).tolist()
            edited = [[] if h and e == 0 else [y] if h and e == 1 else [x, y] if h else [x] for x, y, h, e in zip(w.tolist(), new, hit, kind, strict=True)]
            probe.append((i, np.array(sum(edited, []) or [0], np.uint64)))  # from lists of integers: with an empty one, concatenate gives floats
        found = np.zeros(len(probe), bool)
        for _ in range(most):
            turns = rng.integers(0, 2**63, 2 * long, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            steps = np.sort(rng.choice(max(SAMPLED, int(1.6 * long)), min(SAMPLED, max(1, long)), replace=False))
            steps = steps[steps < 2 * long]
            stop = at + long  # no item window sees beyond itself
            ends = begin[1:][np.searchsorted(begin, at, "right") - 1] - 1
            _, keys, partial = _walk(words, at, np.minimum(ends, stop), turns, steps, None)
            maps = []
            for p in partial:
                m = np.zeros(1 << BITS, bool)
                m[(p >> np.uint64(64 - BITS)).astype(np.int64)] = True
                maps.append(m)
            by = np.argsort(keys, kind="stable")
            rep = Repetition(long, stride, turns, steps, maps, keys[by], item[by].astype(np.int32), where[by].astype(np.int32))
            out.append(rep)
            left = np.flatnonzero(~found)
            texts = [np.concatenate([rng.integers(1, 2**62, int(rng.integers(0, stride)) + stride).astype(np.uint64), probe[k][1], rng.integers(1, 2**62, 5).astype(np.uint64)]) for k in left]
            if texts:
                for row, j, _ in candidates(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), [rep]):
                    found[left[row]] |= j == probe[left[row]][0]
            if min(found[k::KINDS].mean() for k in range(KINDS)) >= target:
                break
        else:
            raise RuntimeError(f"items of the size class {long} do not reach a recall of {target} in {most} repetitions")
    return out


def candidates(words: np.ndarray, first: np.ndarray, reps: list[Repetition]) -> set[tuple[int, int, int]]:
    """(row, item, place of the item's begin in the row) of windows that fall together with an item's in some repetition."""
    out: set = set()
    closed, begin = _closed(words, first)
    size = np.diff(first)
    starts: dict = {}
    for r in reps:
        if (r.long, r.stride) not in starts:
            n = np.maximum(0, -(-(size - r.long // 2) // r.stride))
            row = np.repeat(np.arange(len(size)), n)
            offset = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * r.stride
            starts = {(r.long, r.stride): (row, offset)}
        row, offset = starts[r.long, r.stride]
        at = begin[row] + offset
        live, key, _ = _walk(closed, at, np.minimum(begin[row + 1] - 1, at + r.long), r.turns, r.steps, r.maps)
        if not len(live):
            continue
        a, b = np.searchsorted(r.keys, key), np.searchsorted(r.keys, key, "right")
        for w, i, j in zip(live[a < b].tolist(), a[a < b].tolist(), b[a < b].tolist(), strict=True):
            out.update((int(row[w]), int(r.item[m]), int(offset[w] - r.place[m])) for m in range(i, j))
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any passage of the text, and the end of such a passage."""
    columns = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - columns) + columns
    end = int(row.argmin())
    return int(row[end]), end


def found_in(words: np.ndarray, first: np.ndarray, known: list[np.ndarray], reps: list[Repetition], max_edit: float, one: bool = False) -> dict[tuple[int, int], int]:
    """(row, item): distance of the verified pairs; one: no more than one pair for each row."""
    best: dict = {}
    done: set = set()
    for row, item, place in sorted(candidates(words, first, reps)):
        w = known[item]
        if row in done or best.get((row, item)) == 0:
            continue
        slack = int(max_edit * len(w)) + 1
        a = max(int(first[row]), int(first[row]) + place - slack)
        passage = words[a : max(a, min(int(first[row + 1]), int(first[row]) + place + len(w) + slack))]
        # A word of the item that is nowhere in the passage is an edit.
        absent = ~np.isin(w, passage) if len(w) * len(passage) > 100_000 else ~(w[:, None] == passage).any(1)
        if absent.sum() > max_edit * len(w):
            continue
        d, _ = edit_distance(w, passage)
        if d <= max_edit * len(w) and d < best.get((row, item), math.inf):
            best[row, item] = d
            if one:
                done.add(row)
    return best


def _blocks(benchmark: DataFrame, max_edit: float, block_bytes: int):
    """Broadcasts of (ids, word hashes, repetitions), each of items of about block_bytes of text, but for an item that is longer."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        words, first = tokens(own["text"])
        known = [words[first[i] : first[i + 1]] for i in range(own.num_rows)]
        yield spark.sparkContext.broadcast((own["item_id"].to_pylist(), known, repetitions(known, edits=max_edit)))


def matches(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_words): all found pairs of a text and an item of which it has a passage within max_edit."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for shared in _blocks(benchmark, max_edit, block_bytes):

        def run(batches, shared=shared):
            ids, known, reps = shared.value
            for whole in batches:
                for b in slices(whole, "text"):
                    best = found_in(*tokens(b.column("text")), known, reps, max_edit)
                    doc = b.column("doc_id").to_pylist()
                    found = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc[r] for r, _ in found], pa.int64()), pa.array([ids[i] for _, i in found], pa.int64()), pa.array([best[x] for x in found], pa.int32()), pa.array([len(known[i]) for _, i in found], pa.int32())],
                        ["doc_id", "item_id", "distance", "item_words"],
                    )

        part = rows.mapInArrow(run, "doc_id long, item_id long, distance int, item_words int")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("item_words").alias("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The documents without a passage of any item: each row by itself, whatever its id, and without a shuffle."""
    for shared in _blocks(benchmark, max_edit, block_bytes):

        def run(batches, shared=shared):
            _, known, reps = shared.value
            for whole in batches:
                for b in slices(whole, text):
                    keep = np.ones(b.num_rows, bool)
                    keep[[row for row, _ in found_in(*tokens(b.column(text)), known, reps, max_edit, True)]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
