"""Helpers shared by the training-data operators: shared-folder tables, byte-level
word splitting over Arrow buffers, and connected components."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a fresh local one only where it is unset and all runs on one machine (tests)."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} has to name a folder that all executors share")
        named = getattr(spark, "_pagemill_dir", None) or "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark._pagemill_dir = named
    return named.rstrip("/")


class Tables:
    """Tables that one run has written to the shared folder and not dropped yet."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self, keep: int = 0) -> None:
        """Deletes all but the last keep of them; nothing that reads them may run any more."""
        gone = self.paths[: len(self.paths) - keep]
        for path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = self.paths[len(gone) :]


_run: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("tables of the run", default=None)


@contextlib.contextmanager
def own_tables(spark: SparkSession) -> Iterator[Tables]:
    """What is written within the block, by this thread, belongs to the Tables that it gets; runs of other threads have their own."""
    mine = Tables(spark)
    before = _run.set(mine)
    try:
        yield mine
    finally:
        _run.reset(before)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors; it stays until it is dropped."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    mine = _run.get()
    if mine is not None:
        mine.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Within the block, Spark plans Arrow batches of about so many bytes, for rows that are large; a plan keeps the size it was made with."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(most))
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def crc_mod(col, m: int = 5):
    """crc32 of the decimal text of an integer id, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


# ---------------------------------------------------------------- expressions


def prefix(values: Column, combine, zero: int = 0, chunk: int = 256) -> Column:
    """What an associative combine makes of all values before each one; in chunks, as an array that grows is copied at each step."""

    def walk(array, value):
        start = F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(array, start, lambda acc, x: F.struct(combine(acc["at"], value(x)).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / chunk).cast("int")), lambda k: walk(F.slice(v, k * chunk + 1, F.lit(chunk)), lambda x: x))
    joined = lambda own: let(walk(own, lambda x: x["at"])["out"], lambda heads: F.flatten(F.transform(own, lambda c, k: F.transform(c["out"], lambda x: combine(F.get(heads, k), x)))))
    return let(values, lambda v: let(chunks(v), joined))


def let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


# ---------------------------------------------------------------- text buffers

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and for each row the index of its first word (n+1 entries); separator: by byte."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(buf)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    closing = offsets[1:][offsets[1:] > 0] - 1
    last[closing] = word[closing]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), RADIX, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int = 0) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) words; first: of so many leading bytes only, 0 for all."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    if first:
        size = np.minimum(size, first)
        total = np.zeros(len(starts), np.uint64)
        power = powers(first)
        for k in range(first):
            has = size > k
            total[has] += BYTE_CODE[LOWER[buf[starts[has] + k]]] * power[k]
        return mixed(total + powers(first + 1)[first])
    begin = np.repeat(starts, np.diff(np.append(starts, len(buf))))
    place = np.arange(starts[0], len(buf)) - begin
    value = BYTE_CODE[LOWER[buf[starts[0] :]]] * powers(int(size.max()) if len(size) else 1)[np.minimum(place, int(size.max()) - 1)]
    value[place >= np.repeat(size, np.diff(np.append(starts, len(buf))))] = 0
    return mixed(np.add.reduceat(value, starts - starts[0]))


def row_sums(values: np.ndarray, bounds: np.ndarray, how=np.add, empty=0):
    """how.reduceat over [bounds[i], bounds[i+1]); rows without values get empty."""
    out = np.full(len(bounds) - 1, empty, np.result_type(values.dtype, type(empty)) if len(values) else np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = how.reduceat(values, bounds[full])
    return out


def slices(batch, column: str, limit: int = 1 << 20):
    """The batch in slices of whole rows with about limit bytes of text each; a longer text makes a slice of its own."""
    at, (_, offsets) = 0, buffer_of(batch.column(column))
    while at < batch.num_rows:
        to = min(at + 2**16, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most max_rows rows that may be learned from, those of the smallest id hash."""
    rows = labels.where((crc_mod("doc_id") != 0) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)


#: Frequent short words by language (fixed values).
STOP_WORDS = {
    "en": "the of and to in is that it for was with as this are on be at by not you",
    "de": "der die und das ist nicht ein eine zu mit von den des sich auf im dem auch es für",
    "fr": "le la les et des un une est dans que qui pour pas sur du au avec ce il ne",
    "es": "el los las y una que por con para del se su al lo como más pero no es en",
}


def stop_hashes() -> dict[str, np.ndarray]:
    out = {}
    for lang, words in STOP_WORDS.items():
        buf = np.frombuffer(words.encode(), np.uint8)
        starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]))
        out[lang] = np.sort(word_hashes(buf, starts, ends))
    return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


# ---------------------------------------------------------------- components


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable over links.

    Alternates large-star and small-star contractions (each one grouped pass over
    the remaining links), and writes the links to the shared folder every round;
    no link or component comes to the driver, only a count and a checksum.
    The longest path may have about 2**(rounds/2) links.
    """
    partitions = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Links are few beside what they come from: a quarter of the files.
    e = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct().coalesce(max(1, partitions // 4)), "links")
    told = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = told(e)
    for _ in range(rounds):
        # Large star: every larger neighbour of a node goes to the smallest of its neighbourhood.
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        big = both.where("y > x").join(low, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = big.groupBy("v").agg(F.min("u").alias("m"))
        ends = F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), "v"))
        small = big.join(least, "v").select(F.explode(ends).alias("l")).select("l.u", "l.v").where("u <> v").distinct()
        # A file for some hundred thousand links: rounds over few links write few files.
        e = written(small.coalesce(max(1, min(partitions, -(-before[0] // 500_000)))), "links")
        now = told(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(e.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
