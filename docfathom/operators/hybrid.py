"""Hybrid search: BM25 and vector lists fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fts, vector

RRF_K, DEFAULT_LIMIT, FETCH = 60, 20, 3


@dataclass(frozen=True)
class SearchOptions:
    """Filters (an empty list is no filter) and the number of results."""

    api_id: str | None = None
    api_ids: Sequence[str] | None = None
    types: Sequence[str] | None = None
    limit: int = DEFAULT_LIMIT

    @property
    def sources(self) -> list[str]:
        return [*([self.api_id] if self.api_id else []), *(self.api_ids or [])]


def fuse(lexical: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """query_id, id, score, fts_rank, vec_rank, position: sums of 1 / (60 + rank); ties as listed, lexical results first."""
    parts = lexical.select("query_id", "id", "fts_rank", F.lit(None).cast("int").alias("vec_rank"))
    parts = parts.unionByName(near.select("query_id", "id", F.lit(None).cast("int").alias("fts_rank"), "vec_rank"))
    share = F.lit(1.0) / (RRF_K + F.coalesce("fts_rank", "vec_rank"))
    fused = parts.groupBy("query_id", "id").agg(F.sum(share).alias("score"), F.min("fts_rank").alias("fts_rank"), F.min("vec_rank").alias("vec_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vec_rank"))
    return fused.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def search(query: str, query_vector: Sequence[float], chunks: DataFrame, vectors: DataFrame, index: DataFrame, stats: DataFrame, options: SearchOptions = SearchOptions(), mode: str = "post") -> DataFrame:
    """The fused results of one query as one plan; limits apply before ids without a chunk are dropped."""
    fetch = FETCH * options.limit
    asked = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
    lexical = fts.search(asked, index, stats, fetch, options.sources, options.types)
    kept = chunks.filter(fts._as_filter(options.sources, options.types)) if options.sources or options.types else None
    near = vector.search(vectors, query_vector, fetch, kept, mode).withColumn("query_id", F.lit(0).cast("long"))
    return fuse(lexical, near, options.limit)


def search_batch(queries: DataFrame, vectors: DataFrame, index: DataFrame, stats: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """search() for a table of queries (query_id long, query, vector) without filters, in one job."""
    lexical = fts.search(queries.select("query_id", "query"), index, stats, FETCH * limit)
    near = vector.search_batch(vectors, queries, FETCH * limit)
    return fuse(lexical, near, limit)


def hydrate(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their chunks, in order; ids without a chunk are dropped. Results of many queries are joined by a shuffle."""
    return chunks.join(fts.held(found)[0], "id").orderBy("query_id", "position")
