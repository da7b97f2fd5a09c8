"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within half the radius of
both.  Emitting the whole ball of every fingerprint (2081 variants of 64 bits) is
only needed where many fingerprints crowd together, so it comes second:

(That emitting it for all is too much is computed, not measured: see the README;
``links(fps, crowd=0)`` does so.)

1. One of the two 32-bit halves of linked fingerprints differs in at most half the
   radius.  Every distinct fingerprint emits, for each half, the ball of half of
   *that* radius (33 variants); rows are shuffled on variants, and within a group
   of up to ``crowd`` fingerprints colliding pairs are verified on all 64 bits.
2. Fingerprints of larger groups emit their whole ball.  All that share a variant
   are linked for certain, so a group links its members to its first one; no pair
   is formed, however large the group.

Both find all links or links that connect the same fingerprints.  Groups stream
in sorted order, with a bounded part of a group in memory.  Exact copies collapse
before anything is emitted.

Defined cases: null and empty texts have no words and fingerprint zero, which links
like any other; a text of fewer words than a shingle is one shingle; rows with a
null id are returned with a null component and link nothing; repeated rows are
returned as often as they occur; equal fingerprints are one; an empty table gives an
empty one; other columns are ignored, and stay in ``deduplicated``.  A very long text
is worked on whole, in about 45 times its bytes of memory, other texts a MB at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from pagemill.llm.common import LOWER, batches_of, buffer_of, connected_components, mixed, slices, word_bounds, written


def shingle_hashes(column, words: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all rows, and each row's number of shingles."""
    buf, offsets = buffer_of(column)
    n = len(offsets) - 1
    starts, ends, first = word_bounds(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    # The lower-cased words, each followed by one space.
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    plain = np.full(int(size.sum()) + len(size), 32, np.uint8)
    inside = np.repeat(np.arange(len(size)), size)
    plain[np.arange(len(inside)) + inside] = LOWER[buf[np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)]]
    raw = plain.tobytes()
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    bounds = np.cumsum(np.append(0, shingles))
    row = np.repeat(np.arange(n), shingles)
    begin = np.arange(bounds[-1]) - bounds[row] + first[row]
    last = np.minimum(begin + words, first[row + 1]) - 1
    a, b = at[begin].tolist(), (at[last] + size[last]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64), shingles


def bit_sums(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(rows, 64): in how many of a row's hashes each bit is set."""
    row = np.repeat(np.arange(len(shingles)), shingles)
    step = 1 << 15  # hashes whose bits are unpacked at a time; their counts fit 16 bits
    sums = np.zeros((len(shingles), 64), np.int64)
    for k in range(0, len(h), step):
        bits = np.unpackbits(h[k : k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = row[k : k + step]
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums[part[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.uint16)
    return sums


def packed(sums: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    return np.packbits(2 * sums > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(column, words: int = 4, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints of a string column; zero for rows without words."""
    h, shingles = shingle_hashes(column, words, seed)
    return packed(bit_sums(h, shingles), shingles)


def with_fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fingerprints_of(b.column("text"), words).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """The masks of at most radius bits out of bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _groups(batches, key: str, finish, limit: int, tell_last: bool = False, others: tuple = ("fp", "rep")):
    """Calls finish([keys, fps, reps]) on sorted rows, whole groups at a time but for those over limit rows; of these it gets
    parts.  tell_last: it is told the end."""
    kept = None
    for b in batches:
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in (key, *others)]
        cols = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
        if not len(cols[0]):
            continue
        tail = int(np.searchsorted(cols[0], cols[0][-1]))
        if len(cols[0]) - tail > limit:
            tail = len(cols[0])  # the last group's part goes, too
        if tail:
            yield from finish([c[:tail] for c in cols])
        kept = [c[tail:] for c in cols]
    if kept is not None and len(kept[0]):
        yield from finish(kept, True) if tell_last else finish(kept)


def links(fps: DataFrame, radius: int = 4, crowd: int = 64) -> DataFrame:
    """(a, b), a < b: links between rep values of distinct fingerprints (fp, rep) that connect all within radius bits."""
    if radius % 2:
        raise ValueError("the radius has to be even: two balls of half of it meet")
    half_ball, whole_ball = ball(32, -(-(radius // 2) // 2)), ball(64, radius // 2)
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64())])

    def emit_halves(batches):
        for b in batches:
            fp, rep = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            u = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.uint64)
            low, high = u & np.uint64(0xFFFFFFFF), u >> np.uint64(32)
            keys = np.concatenate([(low[:, None] ^ half_ball).ravel(), (high[:, None] ^ half_ball).ravel() | np.uint64(1 << 32)])
            many = [np.tile(np.repeat(x, len(half_ball)), 2) for x in (fp, rep)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, many)], ["key", "fp", "rep"])

    def emit_ball(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                fp, rep = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
                yield pa.RecordBatch.from_arrays([pa.array((fp.view(np.uint64)[:, None] ^ whole_ball).ravel().view(np.int64)), *(pa.array(np.repeat(x, len(whole_ball))) for x in (fp, rep))], ["key", "fp", "rep"])

    def out(a, b, fp=None):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(fp if fp is not None else np.zeros(len(a), np.int64), pa.int64())], schema=pair)

    def verify(batches):
        """Rows with b are links; rows without are of a crowd."""
        crowded = set()

        def finish(cols):
            key, fp, rep = cols
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(starts, len(key)))
            dense = size > crowd
            if len(starts) and int(key[0]) in crowded:
                dense[0] = True
            crowded.clear()
            if dense[-1]:
                crowded.add(int(key[-1]))  # its group may go on
            in_crowd = np.repeat(dense, size)
            if in_crowd.any():
                r, f = rep[in_crowd], fp[in_crowd]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.nulls(len(r), pa.int64()), pa.array(f, pa.int64())], schema=pair)
            key, fp, rep = key[~in_crowd], fp[~in_crowd], rep[~in_crowd]
            shift = 1
            while shift < len(key):
                same = np.flatnonzero(key[shift:] == key[:-shift])
                if not len(same):
                    break
                near = same[np.bitwise_count(fp[same].view(np.uint64) ^ fp[same + shift].view(np.uint64)) <= radius]
                if len(near):
                    yield out(np.minimum(rep[near], rep[near + shift]), np.maximum(rep[near], rep[near + shift]))
                shift += 1

        yield from _groups(batches, "key", finish, 4 * crowd + 4)

    def star(batches):
        """The first member of each group with all others."""
        last: list = [None, None]

        def finish(cols):
            key, _, rep = cols
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            heads = rep[starts]
            if last[0] == int(key[0]):
                heads[0] = last[1]
            last[:] = int(key[-1]), heads[-1]
            head = np.repeat(heads, np.diff(np.append(starts, len(key))))
            ok = head != rep
            if ok.any():
                yield out(np.minimum(head[ok], rep[ok]), np.maximum(head[ok], rep[ok]))

        yield from _groups(batches, "key", finish, 1024)

    rows = "key long, fp long, rep long"
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    halves = fps.select("fp", "rep").mapInArrow(emit_halves, rows).repartition(n, "key").sortWithinPartitions("key", "fp")
    met = written(halves.mapInArrow(verify, "a long, b long, fp long").distinct(), "met")
    crowd_fps = met.where("b IS NULL").select("fp", F.col("a").alias("rep")).distinct()
    balls = crowd_fps.repartition(n, "fp").mapInArrow(emit_ball, rows).repartition(n, "key").sortWithinPartitions("key", "rep")
    return met.where("b IS NOT NULL").select("a", "b").unionAll(balls.mapInArrow(star, "a long, b long, fp long").select("a", "b")).distinct()


BANDS, ROWS = 16, 5  #: keys of a text, and minima that a key is made of: two texts of similarity 0.8 share a key with a probability of 0.998
SURE = 0.2  #: four deviations of the similarity that BANDS * ROWS minima estimate; pairs below by more are not verified
BLOCK = 1 << 20  #: shingles of a crowded group's members that one task holds
SHARE = 64  #: blocks' worth of shingles of all of a group's members that one task compares with a block
BATCH = 16 << 20  #: bytes of sets of shingles that Spark and Python hold at a time
_TURN = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima_of(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(rows, BANDS * ROWS): the least of each row's hashes under as many orders; all ones for rows without shingles."""
    out = np.full((len(shingles), len(_TURN)), ~np.uint64(0), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        cuts = (np.cumsum(shingles) - shingles)[full]
        for k, turn in enumerate(_TURN):
            out[full, k] = np.minimum.reduceat((h ^ (turn >> np.uint64(7))) * turn, cuts)
    return out


def sketched(docs: DataFrame, words: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, written, with the columns of a sketch of each text's set of shingles: _row (unique), _id, _same (tells sets
    apart), _fp, _n (shingles), _keys and _mins."""
    kept = docs.columns

    def run(batches):
        for whole in batches:
            for b in slices(whole, text):
                h, shingles = shingle_hashes(b.column(text), words)
                sets = [np.unique(x) for x in np.split(h, np.cumsum(shingles)[:-1])]
                u, n = np.concatenate(sets), np.array([len(x) for x in sets])
                low = minima_of(u, n)
                keys = np.zeros((len(low), BANDS), np.uint64)
                for j in range(BANDS):
                    for k in range(ROWS):
                        keys[:, j] = mixed(keys[:, j] + low[:, j * ROWS + k] * np.uint64(2 * k + 1) + np.uint64(j))
                raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
                cols = [b.column(id_col).cast(pa.int64()), same, pa.array(packed(bit_sums(u, n), n).view(np.int64)), pa.array(n), raw(keys.astype("<u8")), raw((low >> np.uint64(5)).astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, "_id", "_same", "_fp", "_n", "_keys", "_mins"])

    more = [("_id", LongType()), ("_same", BinaryType()), ("_fp", LongType()), ("_n", LongType()), ("_keys", BinaryType()), ("_mins", BinaryType())]
    schema = StructType([*docs.schema.fields, *(StructField(*x) for x in more)])
    return written(docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "sketches")


def sets_of(table: DataFrame, need: DataFrame, words: int, text: str) -> DataFrame:
    """(rep, hashes): the sorted shingle hashes of the rows of a table whose _row is a rep of need; written."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                h, shingles = shingle_hashes(b.column("text"), words)
                found = [np.unique(x).astype("<u8").tobytes() for x in np.split(h, np.cumsum(shingles)[:-1])]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(found, pa.binary())], ["rep", "hashes"])

    # The reps grow with the input: no broadcast, however few they are here.
    texts = table.select(F.col("_row").alias("rep"), F.col(text).alias("text")).join(need.select("rep").distinct().hint("merge"), "rep", "left_semi")
    return written(texts.mapInArrow(run, "rep long, hashes binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of reps whose sets have an exact Jaccard similarity of at least similarity."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    side = lambda x: sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _meet(crowd: int, hubs: int):
    """Over rows sorted by key: rows with b are pairs; rows without belong to a group of more than crowd members, or to one that may go on in another task."""

    def rows(a, b=None, key=None):
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if x is None else pa.array(np.ascontiguousarray(x)) for x in (a, b, key)], ["a", "b", "key"])

    def run(batches):
        state: dict = {"first": True, "key": None}

        def finish(cols, last=False):
            key, rep = cols
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(starts, len(key)))
            open_ = size > crowd
            # The first and the last group of a task may have members in another one, and so may parts of one that outgrew the limit.
            open_[0] |= state["first"] or int(key[0]) == state["key"]
            open_[-1] |= last
            state["first"] = False
            wide = np.repeat(open_, size)
            if wide.any():
                yield rows(rep[wide], None, key[wide])
            found = []
            k2, r2 = key[~wide], rep[~wide]
            for shift in range(1, crowd):
                same = np.flatnonzero(k2[shift:] == k2[:-shift]) if shift < len(k2) else []
                if not len(same):
                    break
                found.append((r2[same], r2[same + shift]))
            for g in np.flatnonzero(open_).tolist():
                r = rep[starts[g] : starts[g] + size[g]]
                if int(key[starts[g]]) != state["key"]:
                    # Members of least hash: mostly the same ones under all keys of a family.
                    picked = np.argsort(mixed(r.view(np.uint64)), kind="stable")[:hubs]
                    state["key"], state["hubs"] = int(key[starts[g]]), r[picked]
                for hub in state["hubs"]:
                    found.append((np.full(int((r != hub).sum()), hub), r[r != hub]))
            if found and sum(len(x) for x, _ in found):
                out = _pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield rows(out.column("a").to_numpy(), out.column("b").to_numpy())

        yield from _groups(batches, "key", finish, 1 << 16, tell_last=True, others=("rep",))

    return run


class _Block:
    """Sets by their members: how many of them each of some texts shares with a further one."""

    STEP = 2048  #: texts that are counted together

    def __init__(self, rows: list[tuple]):
        self.rep, self.component, sets = rows[0]
        if len(rows) > 1:
            self.rep, self.component, sets = (np.concatenate(x) for x in zip(*rows, strict=True))
        self.size = np.array([len(x) // 8 for x in sets])
        self.parts = []
        for k in range(0, len(sets), self.STEP):
            own = [np.frombuffer(x, "<u8") for x in sets[k : k + self.STEP]]
            members, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            by = np.argsort(members, kind="stable")
            members, first = np.unique(members[by], return_index=True)
            self.parts.append((members, np.append(first, len(by)), owner[by], len(own)))

    def shared(self, x: np.ndarray) -> np.ndarray:
        out = []
        for members, first, owner, n in self.parts:
            at = np.searchsorted(members, x)
            at = at[(at < len(members)) & (members[np.minimum(at, len(members) - 1)] == x)] if len(members) else at[:0]
            many = first[at + 1] - first[at]
            place = np.arange(int(many.sum())) + np.repeat(first[at] - (np.cumsum(many) - many), many)
            out.append(np.bincount(owner[place], minlength=n))
        return np.concatenate(out)


def _across(similarity: float):
    """Over rows (key, salt, turn, side, rep, component, main, hashes): a link between any two components that a text of a block
    (side 0) and one of its group (side 1) connect by an exact similarity."""

    def run(batches):
        at, held, block = None, [], None
        for b in batches:
            key, salt, turn, side, rep, comp, main = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "turn", "side", "rep", "component", "main"))
            sets = b.column("hashes")
            cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (turn[1:] != turn[:-1]) | (side[1:] != side[:-1]))), len(key))
            found: dict = {}
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (int(key[i]), int(salt[i]), int(turn[i])) != at:
                    at, held, block = (int(key[i]), int(salt[i]), int(turn[i])), [], None
                if side[i] == 0:
                    held.append((rep[i:j], comp[i:j], np.array([*map(bytes, (x.as_buffer() for x in sets[i:j])), None], object)[:-1]))
                    continue
                if not held:
                    continue
                block = block or _Block(held)
                for k in range(i, j):
                    own = np.frombuffer(sets[k].as_buffer(), "<u8")
                    n, shared = len(own), block.shared(own)
                    # Members of the main component are in no block; of two others, the lesser one's block has the pair.
                    ok = (shared >= similarity * (n + block.size - shared)) & (block.component != comp[k]) & ((comp[k] == main[k]) | (block.rep < rep[k]))
                    for x in np.flatnonzero(ok).tolist():
                        found.setdefault((int(block.component[x]), int(comp[k])), (int(block.rep[x]), int(rep[k])))
            if found:
                a, b_ = (np.array(x) for x in zip(*found.values(), strict=True))
                yield _pairs(a, b_)

    return run


def similar_links(reps: DataFrame, table: DataFrame, words: int, similarity: float, more: DataFrame, crowd: int = 8, hubs: int = 4, text: str = "text") -> DataFrame:
    """(node, component) of reps (rep, fp, n, keys, mins) over links of an exact similarity; more: further candidates.

    Texts of a similarity of 0.8 differ in ten bits of a fingerprint or so, out of any ball's reach, but share one of BANDS
    keys, each made of ROWS least hashes.  Rows are shuffled on keys, sorted, and cut into tasks of equal size wherever that
    is, so that a key of any size meets in no single task.  Pairs within groups of up to crowd members, and of larger
    groups' members with ``hubs`` of them, are verified first.  Then all members of a group that are not of its main
    component are compared with all others, block by block: a group of any size is dealt out to as many tasks as it has
    blocks, times the turns that all its members take, and a task tells one link for any two components.
    """
    n = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def emit(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column("rep").to_numpy(zero_copy_only=False), BANDS))], ["key", "rep"])

    keyed = reps.select("keys", "rep").mapInArrow(emit, "key long, rep long")
    met = written(keyed.repartitionByRange(n, "key", "rep").sortWithinPartitions("key", "rep").mapInArrow(_meet(crowd, hubs), "a long, b long, key long"), "met")
    crowded = met.where("b IS NULL").select("key", F.col("a").alias("rep"))
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("mins").alias(f"s{x}"))

    def estimate(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            ok = pa.array((x == y).mean(1) >= similarity - SURE)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    pairs = met.where("b IS NOT NULL").select("a", "b").unionAll(more).distinct()
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(estimate, "a long, b long"), "likely")
    need = likely.select(F.col("a").alias("rep")).unionAll(likely.select(F.col("b").alias("rep"))).unionAll(crowded.select("rep"))
    sets = sets_of(table, need, words, text)
    with batches_of(table.sparkSession, BATCH):
        same = written(verified(likely, sets, similarity), "same")
    parts = connected_components(same)
    crowded = crowded.join(parts, F.col("rep") == F.col("node"), "left").join(reps.select("rep", "n"), "rep")
    crowded = written(crowded.select("key", "rep", "n", F.coalesce("component", "rep").alias("component")), "crowded")
    sizes = crowded.groupBy("key", "component").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    apart = sizes.where("kinds > 1").select("key", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("all") / (SHARE * BLOCK)).cast("int").alias("turns"))
    rows = crowded.join(apart, "key").join(sets, "rep")
    part = lambda of, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = rows.where("component <> main").withColumn("salt", part("blocks", 1)).withColumn("turn", each("turns")).withColumn("side", F.lit(0))
    right = rows.withColumn("turn", part("turns", 2)).withColumn("salt", each("blocks")).withColumn("side", F.lit(1))
    cell = ["key", "salt", "turn"]
    dealt = left.unionByName(right).select(*cell, "side", "rep", "component", "main", "hashes").repartition(n, *cell).sortWithinPartitions(*cell, "side")
    with batches_of(table.sparkSession, BATCH):
        rest = written(dealt.mapInArrow(_across(similarity), "a long, b long"), "rest")
    # Components so far are stars already.
    return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(rest))


def similar_classes(table: DataFrame, words: int, similarity: float, radius: int = 4, text: str = "text") -> DataFrame:
    """(_same, group): the group of each set of shingles of a sketched table, of those that links of a similarity connect."""
    found = table.groupBy("_same").agg(F.min_by(F.struct("_row", "_fp", "_n", "_keys", "_mins"), "_row").alias("r"))
    classes = written(found.select("_same", F.col("r._row").alias("rep"), F.col("r._fp").alias("fp"), F.col("r._n").alias("n"), F.col("r._keys").alias("keys"), F.col("r._mins").alias("mins")), "classes")
    reps = classes.where("n > 0").drop("_same")
    # Of texts with one fingerprint each is within radius of all; the first one stands for them.
    distinct = reps.groupBy("fp").agg(F.min("rep").alias("first"))
    equal = reps.select("rep", "fp").join(distinct, "fp").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    close = links(distinct.select("fp", F.col("first").alias("rep")), radius).unionAll(equal)
    parts = similar_links(reps, table, words, similarity, close, text=text)
    return classes.select("_same", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("_same", F.coalesce("component", "rep").alias("group"))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of texts that are linked by an exact Jaccard similarity of their shingles; null and empty texts are alike.

    Candidates are texts within radius bits, and those of similar_links.  component_id is the smallest doc_id of a group;
    rows with a null id have a null one and link nothing.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = sketched(named.where("doc_id IS NOT NULL"), words)
    groups = written(similar_classes(table, words, similarity, radius), "groups")
    least = table.groupBy("_same").agg(F.min("_id").alias("least")).join(groups, "_same").groupBy("group").agg(F.min("least").alias("component_id"))
    told = groups.join(least, "group").select("_same", "component_id")
    found = table.select("doc_id", "_same").join(told, "_same").select("doc_id", "component_id")
    return found.unionAll(named.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of similar texts, that of the smallest id; a null id counts as the largest, and of equal ids one row stays."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever docs' columns are called
    of = dict(zip(docs.columns, names, strict=True))
    table = sketched(docs.toDF(*names), words, of[id_col], of[text])
    groups = similar_classes(table, words, similarity, radius, of[text])
    best = table.groupBy("_same").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("best"))
    stays = best.join(groups, "_same").groupBy("group").agg(F.min("best").alias("best")).select("best._row")
    # No broadcast: what stays grows with the input.
    return table.join(stays.hint("merge"), "_row", "left_semi").select(*names).toDF(*docs.columns)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, crowd: int = 64, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    fps = written(with_fingerprints(docs, words, id_col, text), "fps")
    reps = written(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    parts = connected_components(links(reps, radius, crowd))
    classes = reps.join(parts, reps.rep == parts.node, "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    joined = fps.join(classes, (fps.fp == classes._fp) & fps.doc_id.isNotNull(), "left")
    return joined.select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
