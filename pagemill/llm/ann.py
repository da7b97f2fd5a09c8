"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Vectors are scaled to length 1, rotated at random and assigned to the nearest of the
centroids, which are fitted on a bounded sample.  A query probes its nearest lists;
each list (in salted shares of bounded expected size, as are the queries that probe
it) is scanned in blocks of columns: after each block, a hypothesis test on the
partial distance abandons candidates that are too far with near certainty.  Survivors get their exact cosine in double precision from the
original vectors; the best of all lists win, ties to the smaller id.  A query whose
nearest lists hold too few other ids probes further ones, in order, until it has k.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do vectors whose length differs from that of most of
the sample; rows with a null id take no part; of vectors that repeat an id each is a
candidate and, where it applies, a query, an id is found once, with its best score, and
a query never finds its own id; ties go to the smaller id; components of any finite
size are safe; fewer candidates than asked for give all of them; an empty table gives
an empty one; other columns are ignored.  From 4 million vectors on the number of
lists stays at that which the bounded sample can tell apart (1001), and lists grow.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import written

RECALL = 0.97
SHARE_ROWS = 20_000  #: expected candidates in a share of a list, and queries that meet them at a time


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    x = np.unique(x, axis=0)  # copies of one vector must not take many centroids
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return c


def probes_for(x: np.ndarray, centers: np.ndarray, k: int, queries: int = 300) -> int:
    """The number of lists whose probing finds RECALL of the k nearest of some rows among all rows of x."""
    c2 = (centers * centers).sum(1) / 2
    own = (x @ centers.T - c2).argmax(1)
    ranks = []
    for i in range(0, len(x), max(1, len(x) // queries)):
        d = -(x @ x[i])
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(len(centers), np.int64)
        place[np.argsort(-(centers @ x[i] - c2), kind="stable")] = np.arange(len(centers))
        ranks += place[own[near]].tolist()
    return int(np.quantile(ranks, RECALL, method="higher")) + 1 if ranks else 1


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component: directions stay to the last bit, and squares neither over- nor underflow."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None]) if m.size else m


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.sqrt((m * m).sum(1))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row; the same result for the same two vectors wherever they stand."""
    q, x = scaled(q), scaled(x)
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def scan(q: np.ndarray, x: np.ndarray, k: int, block: int = 16, eps: float = 2.1) -> tuple[np.ndarray, np.ndarray]:
    """For one query among rotated unit vectors: the rows and squared distances of those that are not abandoned.

    Rows come in the order of their distance over the first block of columns, in parts that grow.  The k nearest so far
    bound the distance, and the bound tightens with each part.  Of d out of D columns, a partial squared distance above
    bound * d / D * (1 + eps / sqrt(d))**2 rejects that a candidate is within the bound.
    """
    dim, n = x.shape[1], len(x)
    first = ((x[:, :block] - q[:block]) ** 2).sum(1)
    size = max(64, 4 * k)
    if n <= size or dim <= block:
        return np.arange(n), first + ((x[:, block:] - q[block:]) ** 2).sum(1)
    steps = [m for m in (size, 64 * size, 4096 * size) if m < n]
    order = np.argpartition(first, [m - 1 for m in steps])
    rows = [order[:size]]
    found = [first[rows[0]] + ((x[rows[0], block:] - q[block:]) ** 2).sum(1)]
    for a, b in zip(steps, [*steps[1:], n], strict=True):
        whole = np.concatenate(found)
        bound = np.partition(whole, k - 1)[k - 1]
        kept, done = order[a:b], block
        part = first[kept]
        while True:
            near = part <= (bound * done / dim * (1 + eps / np.sqrt(done)) ** 2 if done < dim else bound) + 1e-9
            kept, part = kept[near], part[near]
            if done == dim or not len(kept):
                break
            to = min(dim, done + block)
            part = part + ((x[kept, done:to] - q[done:to]) ** 2).sum(1)
            done = to
        rows.append(kept)
        found.append(part)
    rows, found = np.concatenate(rows), np.concatenate(found)
    near = found <= np.partition(found, k - 1)[k - 1] + 1e-9
    return rows[near], found[near]


def search(vectors: DataFrame, every: int = 50, k: int = 5, probes: int | None = None, sample_rows: int = 20_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by every, against all rows.

    sample_rows bounds the rows that the centroids are fitted on (those of the
    smallest id hash); every row is indexed.  By default as many lists are probed as
    reach RECALL within the sample, where neighbours are farther than among all rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    base = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    lengths = Counter(len(x) for x in sample["v"].to_pylist())
    dim = max(lengths, key=lambda n: (lengths[n], n))
    base = base.where(F.size("v") == dim)
    known = np.array([x for x in sample["v"].to_pylist() if len(x) == dim])
    turn = rotation(dim)
    total, unique = base.agg(F.count(F.lit(1)), F.countDistinct("vec_id")).first()
    # Lists grow with the root of the input up to what the sample can tell apart.
    lists = int(min(max(1, np.sqrt(total) / 2), len(known) / 20 + 1))
    centers = kmeans(unit(known) @ turn, lists)
    asked = probes or probes_for(unit(known) @ turn, centers, k)

    def assign(batches):
        for b in batches:
            m = _matrix(b.column("v"))
            if len(m):
                own = (unit(m) @ turn @ centers.T - (centers * centers).sum(1) / 2).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column("vec_id"), b.column("v")], ["list", "vec_id", "v"])

    def probe(batches):
        for b in batches:
            m = _matrix(b.column("v"))
            if len(m):
                near = np.argsort(-(unit(m) @ turn @ centers.T - (centers * centers).sum(1) / 2), axis=1, kind="stable").astype(np.int32)
                # As many lists as hold k ids and the query's own; one whose lists are empty but for itself goes on.
                enough = (np.cumsum(held[near], axis=1) <= k).sum(1) + 1
                lists = [row[: max(asked, n)] for row, n in zip(near, enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "v", "lists"])

    index = written(base.mapInArrow(assign, "list int, vec_id long, v array<double>"), "index")
    held = np.zeros(len(centers), np.int64)
    for r in index.groupBy("list").agg(F.countDistinct("vec_id").alias("ids")).collect():  # a row for each list
        held[r["list"]] = r["ids"]
    probes_of = base.where(F.col("vec_id") % every == 0).mapInArrow(probe, "vec_id long, v array<double>, lists array<int>")
    probes_of = written(probes_of, "probes")
    # A row for each list: into how many parts its vectors, and the queries that probe it, are dealt.
    parts = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / SHARE_ROWS), F.lit(1)).cast("int")
    asking = probes_of.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("held")).join(asking, "list", "left").select("list", parts(F.col("held")).alias("shares"), parts(F.col("asked")).alias("turns"))
    sizes = F.broadcast(sizes)
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = index.join(sizes, "list").withColumn("share", part("shares", 1)).withColumn("turn", each("turns"))

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            q, x, ids = _matrix(left["v"]), _matrix(right["v"]), right["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            # Copies of one vector under many ids: of each vector, the k + 1 smallest ids can be among the nearest k.
            _, same = np.unique(x, axis=0, return_inverse=True)
            by = np.argsort(same.ravel(), kind="stable")
            start = np.flatnonzero(np.append(True, np.diff(same.ravel()[by]) != 0))
            place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
            keep = np.sort(by[place <= k])
            x, ids = x[keep], ids[keep]
            turned = unit(x) @ turn
            # Of ids that repeat, so many rows may stand before those of k other ids.
            most = int(np.unique(ids, return_counts=True)[1].max())
            for me, vec, t in zip(left["vec_id"].to_pylist(), q, unit(q) @ turn, strict=True):
                kept, part = scan(t, turned, (k + 1) * most)
                kept = kept[ids[kept] != me]
                if not len(kept):
                    continue
                s = cosines(vec[None, :], x[kept])
                best = np.lexsort((ids[kept], -s))
                if most > 1:
                    best = best[np.sort(np.unique(ids[kept][best], return_index=True)[1])]
                best = best[:k]
                out[0] += [me] * len(best)
                out[1] += ids[kept][best].tolist()
                out[2] += s[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    cell = ["list", "share", "turn"]

    def nearest(asking: DataFrame) -> DataFrame:
        queries = asking.withColumn("list", F.explode("lists")).join(sizes, "list").withColumn("turn", part("turns", 2)).withColumn("share", each("shares"))
        found = queries.select(*cell, "vec_id", "v").groupBy(*cell).cogroup(stored.select(*cell, "vec_id", "v").groupBy(*cell)).applyInArrow(meet, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # of ids that repeat
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if unique == total:
        return nearest(probes_of)
    # An id that repeats in several lists was counted in each: queries left with too few ids look through all lists.
    found = written(nearest(probes_of), "nearest")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, unique - 1)).select("query_id")
    short = probes_of.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti").withColumn("lists", F.sequence(F.lit(0), F.lit(len(centers) - 1)))
    return found.join(full, "query_id", "left_semi").unionByName(nearest(short))
