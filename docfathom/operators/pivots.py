"""Exact nearest neighbours that skip rows by their distances to a few pivots.

A vector that is nearer to the query than r is, by the triangle inequality, as far from each pivot as the query is, give or take r. Those
distances are plain columns of a table sorted by the nearest pivot and the distance to it, so the filter reaches the scan and its row groups.
How much is skipped depends on the vectors: little where all are about equally far from each other, most of them where they lie in clusters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector

#: Pivots, and the vectors that they are chosen from, at most.
PIVOTS, SAMPLE = 8, 5000
#: Distances are rounded to six digits before they are ranked.
SLACK = 2e-6


def choose(vectors: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> list[list[float]]:
    """Pivots for build: vectors that are far from each other, each the farthest from those before it in a sample (the smallest hashes of ids)."""
    rows = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float32).astype(np.float64)
    if not len(x):
        return []
    near, out = ((x - x.mean(0)) ** 2).sum(1), []
    for _ in range(min(n, len(x))):
        out.append(x[int(near.argmax())])
        own = ((x - out[-1]) ** 2).sum(1)
        near = own if len(out) == 1 else np.minimum(near, own)
    return [p.tolist() for p in out]


def _columns(n: int) -> list[str]:
    return [f"pivot_{i}" for i in range(n)]


def build(vectors: DataFrame, pivots: Sequence[Sequence[float]]) -> DataFrame:
    """id, embedding, pivot_0 and so on (distances), sorted within ranges for the writer; rows without a vector are left out."""
    columns = _columns(len(pivots))
    rows = vectors.filter("embedding IS NOT NULL").select("id", "embedding", *[vector.distance(F.col("embedding"), p).alias(c) for c, p in zip(columns, pivots)])
    if not columns:
        return rows
    least = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
    nearest = F.array_position(F.array(*columns), least)
    keyed = rows.withColumn("_least", least).withColumn("_nearest", nearest)
    return keyed.repartitionByRange("_nearest", "_least").sortWithinPartitions("_nearest", "_least").drop("_nearest", "_least")


def _within(pivots: Sequence[Sequence[float]], query: Sequence[float], radius: float) -> Column:
    q = np.array(query, np.float32).astype(np.float64)
    keep = F.lit(True)
    for c, p in zip(_columns(len(pivots)), pivots):
        d = float(np.sqrt(((q - np.array(p, np.float32).astype(np.float64)) ** 2).sum()))
        keep = keep & F.col(c).between(d - radius - SLACK, d + radius + SLACK)
    return keep


def reached(table: DataFrame, pivots: Sequence[Sequence[float]], query: Sequence[float], k: int) -> DataFrame:
    """The rows of a written table that may be among the k nearest.

    Pivot columns alone tell the k rows of the smallest lower bounds; the k-th exact distance of those is the radius that the scan is given.
    """
    if not pivots:
        return table
    q = np.array(query, np.float32).astype(np.float64)
    gaps = [F.abs(F.col(c) - float(np.sqrt(((q - np.array(p, np.float32).astype(np.float64)) ** 2).sum()))) for c, p in zip(_columns(len(pivots)), pivots)]
    bound = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    seeds = table.select(bound.alias("bound")).orderBy("bound").limit(k).collect()
    if len(seeds) < k:
        return table
    near = vector.nearest(table.filter(_within(pivots, query, seeds[-1]["bound"])), query, k).collect()
    return table.filter(_within(pivots, query, near[-1]["distance"]))


def nearest(table: DataFrame, pivots: Sequence[Sequence[float]], query: Sequence[float], k: int) -> DataFrame:
    """id, distance of the k nearest rows, as vector.nearest gives them."""
    return vector.nearest(reached(table, pivots, query, k), query, k)
