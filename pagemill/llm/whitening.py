"""Whitening of embeddings by the principal components of their covariance.

Components are scaled to integers, x = floor(64 c) + 1000000, so that sums are exact.
Rows are centred exactly before anything is multiplied: with S = q n + r, a row's
x - S/n is (x - q) - r/n, whose first part is an integer.  MLlib's RowMatrix adds up
the Gramian of the centred rows; divided by n it is the covariance, small enough for a
local eigh.  The whitening matrix (dimensions times components) is broadcast and
applied in mapInPandas, and what it gives is checked in a further pass: the covariance
of the whitened rows against the identity.

Defined cases: vectors that are null, empty, or hold null or non-finite entries or
entries beyond 2**40 take no part, nor do those of another length than most have (of
two as frequent lengths the greater counts); null and repeated ids are rows like any
other; a component without variance (at most 1e-12 of the largest) cannot be whitened
and is left out, so equal vectors alone give no rows, nor does an empty table; of
equal variances any basis may come; a deviation beyond 64 bits is null; other columns
are ignored.  An Arrow batch of vectors takes about 40 bytes an entry, the driver some
square matrices of the dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**40
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, x): the vectors that take part, as arrays of integers, of whatever length."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def add(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(x), 4096):  # 4096 entries of 2**46 fit in 64 bits
                part = x[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(np.append(part.sum(0), len(part)))], ["at", "s"])

    got = dict(rows.select("x").mapInArrow(add, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    return int(got.get(dim, 0)), [int(got.get(k, 0)) for k in range(dim)]


def covariance(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Of rows (x), divided by n: the Gramian of the exactly centred rows."""
    whole = F.array(*(F.lit(s // n) for s in total))
    rest = F.array(*(F.lit((s % n) / n) for s in total))
    centred = F.zip_with(F.zip_with("x", whole, lambda x, q: (x - q).cast("double")), rest, lambda x, r: x - r)
    frame = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    return RowMatrix(frame, n, len(total)).computeGramianMatrix().toArray() / n


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and their unit components as columns; those without variance are left out."""
    e, c = np.linalg.eigh((v + v.T) / 2)
    e, c = e[::-1][:most], c[:, ::-1][:, :most]
    kept = e > max(e[0], 0) * 1e-12 if len(e) else np.zeros(0, bool)
    return e[kept], c[:, kept]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The exact sum of (n x - S)**2 over each row's entries; null beyond 64 bits."""
    off = x - np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], np.int64)
    rough = ((off.astype(np.float64) * n - rest) ** 2).sum(1)
    small = np.flatnonzero(rough < 2.0**62)
    out: list[int | None] = [None] * len(x)
    for i, d in zip(small.tolist(), ((off[small] * n - rest) ** 2).sum(1).tolist(), strict=True):
        out[i] = d
    for i in np.flatnonzero((rough >= 2.0**62) & (rough < 2.0**64)).tolist():
        d = sum((o * n - r) ** 2 for o, r in zip(off[i].tolist(), rest.tolist(), strict=True))
        out[i] = d if d < 2**63 else None
    return out


def whitened(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    component: from 1 by falling variance; deviation: sum of (n x - S)**2; explained: the
    component's part of all variance; identity_error: the largest absolute entry of the
    whitened rows' covariance minus the identity.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector)
    most = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("x") == most["dim"])
    n, total = sums(rows, most["dim"])
    v = covariance(rows, n, total)
    e, c = principal(v, components)
    if not len(e):
        return spark.createDataFrame([], SCHEMA)
    whole, rest = np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])
    shared = spark.sparkContext.broadcast(c / np.sqrt(e))  # dimensions times components

    def squares(frames):
        for f in frames:
            if len(f):
                y = ((_matrix(f["x"]) - whole) - rest) @ shared.value
                at = np.indices((len(e), len(e))).reshape(2, -1)
                yield pd.DataFrame({"i": at[0], "j": at[1], "s": (y.T @ y).ravel()})

    got = rows.select("x").mapInPandas(squares, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    own = np.zeros((len(e), len(e)))
    own[got["i"], got["j"]] = got["s"] / n
    error = float(np.abs(own - np.eye(len(e))).max())
    explained = e / np.trace(v)

    def whiten(frames):
        for f in frames:
            for at in range(0, len(f), 2048):
                part = f.iloc[at : at + 2048]
                x = _matrix(part["x"])
                k = len(e)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].astype("Int64").repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "n": n,
                    "deviation": pd.array(deviations(x, n, total), "Int64").repeat(k),
                    "whitened": (((x - whole) - rest) @ shared.value).ravel(),
                    "explained": np.tile(explained, len(x)),
                    "identity_error": error,
                })

    return rows.mapInPandas(whiten, SCHEMA)
