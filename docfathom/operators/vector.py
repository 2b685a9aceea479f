"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours are looked for among so many times more rows when a filter follows.
OVER_FETCH = 5
#: Queries and vectors that a task compares: a cell of the grid that a table of queries and the vectors are dealt to.
BLOCK_QUERIES, BLOCK_ROWS = 2000, 20_000


def distance(vector: Column, query: Sequence[float]) -> Column:
    """Euclidean distance in double precision, inside the JVM."""
    q = F.array(*[F.lit(float(np.float32(x))).cast("double") for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, digits: int = 6) -> DataFrame:
    """id, distance of the k nearest rows (ties by id): a projection under a top-k, no shuffle of vectors."""
    told = vectors.filter("embedding IS NOT NULL").select("id", F.round(distance(F.col("embedding"), query), digits).alias("distance"))
    return told.orderBy("distance", "id").limit(k)


def search(vectors: DataFrame, query: Sequence[float], limit: int, chunks: DataFrame | None = None, mode: str = "post") -> DataFrame:
    """id, distance, vec_rank of the nearest rows.

    chunks: the ids that pass a filter. mode "post" takes the nearest OVER_FETCH * limit rows and then filters, so that fewer than limit
    may be left; "pre" filters first.
    """
    if chunks is None:
        found = nearest(vectors, query, limit)
    elif mode == "pre":
        found = nearest(vectors.join(chunks.select("id"), "id", "left_semi"), query, limit)
    else:
        found = nearest(vectors, query, OVER_FETCH * limit).join(chunks.select("id"), "id", "left_semi")
    order = Window.orderBy("distance", "id")  # of at most OVER_FETCH * limit rows
    return found.withColumn("vec_rank", F.row_number().over(order)).filter(F.col("vec_rank") <= limit)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


_CELL = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("distance", pa.float64())])


def _cell(k: int):
    """The k nearest vectors of a cell for each of its queries: one matrix product tells what may be near, then distances are exact."""

    def run(table: pa.Table) -> pa.Table:
        asked = np.array(table.column("query_id").is_valid())
        q, v = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        if not q.num_rows or not v.num_rows:
            return _CELL.empty_table()
        queries, x, own = _matrix(q.column("vector")), _matrix(v.column("vector")), np.array(v.column("id").to_pylist(), object)
        square, n = (x**2).sum(1), min(k, len(x))
        rows = []
        for at in range(0, len(queries), 100):
            part = queries[at : at + 100]
            rough = np.maximum((part**2).sum(1)[:, None] + square - 2 * part @ x.T, 0)
            for i, r in enumerate(rough, at):
                cut = np.sqrt(np.partition(r, n - 1)[n - 1])
                near = np.flatnonzero(np.sqrt(r) <= cut + 1e-5 * (1 + cut) + 1e-6 * (1 + np.sqrt(square.max())))
                d = np.round(np.sqrt(((x[near] - queries[i]) ** 2).sum(1)), 6)
                rows += [(q.column("query_id")[i].as_py(), own[near[j]], float(d[j])) for j in sorted(range(len(near)), key=lambda j: (d[j], own[near[j]]))[:k]]
        return pa.table([pa.array([r[c] for r in rows], _CELL.field(c).type) for c in range(3)], schema=_CELL)

    return run


def search_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, vec_rank for a table of queries (query_id long, vector), of any size: none comes to the driver.

    Both sides are counted and dealt by hash to a grid of blocks; a task compares one block of each, and what it finds for a query is
    ranked with what the others find. Vectors are read once however many queries there are; each is sent to every block of queries.
    """
    rows = vectors.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_v, n_q = blocks(rows, BLOCK_ROWS), blocks(asked, BLOCK_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    side_v = rows.select(mine("id", n_v).alias("v"), every(n_q).alias("q"), F.lit(None).cast("long").alias("query_id"), "id", "vector")
    side_q = asked.select(every(n_v).alias("v"), mine("query_id", n_q).alias("q"), "query_id", F.lit(None).cast("string").alias("id"), "vector")
    found = side_v.unionByName(side_q).groupBy("v", "q").applyInArrow(_cell(k), "query_id long, id string, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("vec_rank", F.row_number().over(order)).filter(F.col("vec_rank") <= k)
