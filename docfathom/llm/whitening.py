"""Whitening of embeddings: principal components of unit variance, from exactly centred integer vectors.

Components of vectors become integers; their sums are exact, so rows can be centred without rounding but for one division. Spark's
RowMatrix adds up the centred rows' Gramian over all partitions; the driver holds that one matrix (dimension squared), takes its
eigenvectors, and broadcasts the projection. A second Gramian, of the whitened rows, says how far they are from the identity.
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
from pyspark.sql import types as T

from . import shared

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Components with less of the largest eigenvalue than this have no direction of their own in double precision.
LEAST = 1e-11
#: Integers modulo 2^64 are the numbers themselves below this.
LONG, END = 1 << 63, 1 << 60


def integral(vec) -> F.Column:
    """floor(64 c) + 1000000 of every component, c as double; beyond 2^60 that is 2^60, so that differences are longs."""
    end = F.lit(END)
    return F.transform(vec, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), -end), end) + F.lit(OFFSET).cast("long"))


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _sums(d: int):
    """Sums of each component over a task's rows, in decimals: no sum of longs overflows them."""

    def run(batches):
        total = [0] * d
        for batch in batches:
            x = _flat(batch.column("x")).reshape(-1, d)
            if len(x):
                high = (x >> 32).sum(axis=0)  # two halves: neither sum leaves a long
                low = (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], names=["at", "total"])

    return run


def deviations(x: np.ndarray, base: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """For each row the sum of (n x - S)^2 with S = n base + rest, exactly; None where that is no long.

    Sums modulo 2^64 are right wherever the true one fits, which a sum of doubles tells but for a narrow edge.
    """
    near = (((x - base).astype(np.float64) * n - rest) ** 2).sum(axis=1)
    whole = (x - base).astype(np.uint64) * np.uint64(n % 2**64) - rest.astype(np.uint64)
    whole = (whole * whole).sum(axis=1, dtype=np.uint64)
    out: list[int | None] = []
    for i, (a, b) in enumerate(zip(near.tolist(), whole.tolist(), strict=True)):
        if a < LONG * (1 - 1e-9):
            out.append(int(b))
        else:
            v = sum((n * (int(p) - int(q)) - int(r)) ** 2 for p, q, r in zip(x[i], base, rest, strict=True)) if a < LONG * (1 + 1e-9) else LONG
            out.append(v if v < LONG else None)
    return out


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of an array column's rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable vector on the leading principal components, with unit variance on each.

    Vectors that are null or hold null or non-finite components are dropped, and so are those of another length than most (of two lengths
    as frequent, the shorter counts), which have no place in one covariance. Null and repeated ids stay as they are: every row counts and
    comes back, and equal rows have equal results. An empty table, or one of vectors without components, gives no rows. Other columns are
    not read. Memory of the driver is bounded by the square of the dimension.

    Returns an array column per row: id, n, deviation (null where it is beyond a long), whitened (by component; null where the component
    has no variance: fewer rows than components, constant ones), and the same in every row: explained (by component; null where all
    vectors are equal) and identity_error (null where no component has variance).
    """
    spark = vectors.sparkSession
    vec = F.col(f"`{vector_col}`")
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec")).filter(vec.isNotNull()).filter(~F.coalesce(odd, F.lit(True)))
    rows = shared.stage(rows.select("id", integral(F.col("vec")).alias("x")), "integral")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("n long, deviation long, whitened array<double>, explained array<double>, identity_error double").fields])
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return spark.createDataFrame([], schema)
    d, n = int(sizes[0]["d"]), int(sizes[0]["count"])
    rows = rows.filter(F.size("x") == d)
    sums = rows.select("x").mapInArrow(_sums(d), "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()
    total = [0] * d
    for r in sums:
        total[r["at"]] = int(r["s"])
    base, rest = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)

    literal = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    whole = F.zip_with("x", literal(base.tolist(), "long"), lambda x, b: (x - b).cast("double"))
    centred = rows.select(F.zip_with(whole, literal((rest / n).tolist(), "double"), lambda x, r: x - r).alias("z"))
    value, vector = np.linalg.eigh(_gramian(centred, "z") / n)
    value, vector = value[::-1].clip(0), vector[:, ::-1]
    k = min(components, d)
    trace, live = float(value.sum()), value[:k] > LEAST * value[0]
    explained = [float(v) / trace if trace > 0 else None for v in value[:k]]
    way = spark.sparkContext.broadcast((base, rest, vector[:, :k][:, live] / np.sqrt(value[:k][live])))

    def project(frames):
        base, rest, turn = way.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            w = ((x - base) - rest / n) @ turn
            yield pd.DataFrame({"id": frame["id"], "deviation": pd.array(deviations(x, base, rest, n), "Int64"), "w": list(w)})

    fields = T.StructType([T.StructField("id", kind), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    done = shared.stage(rows.mapInPandas(project, fields), "whitened")
    error = None
    if live.any():
        m = int(live.sum())
        mean = done.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(m)]).first()
        again = _gramian(done.select(F.zip_with("w", literal(list(mean), "double"), lambda x, m: x - m).alias("z")), "z") / n
        error = float(np.abs(again - np.eye(m)).max())
    place = np.cumsum(live)
    spread = F.array(*[F.col("w")[int(place[i]) - 1] if live[i] else F.lit(None).cast("double") for i in range(k)])
    constant = [F.lit(n).cast("long").alias("n"), literal(explained, "double").alias("explained"), F.lit(error).cast("double").alias("identity_error")]
    return done.select("id", constant[0], "deviation", spread.alias("whitened"), *constant[1:])
