"""Change detection and merging by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(parsed: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Of rows with one key the last in source order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return parsed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def classify(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """id, action (insert, update, skip, delete): one full outer join of (id, content_hash) on both sides."""
    new, old = parsed.select("id", F.col("content_hash").alias("new")), stored.select("id", F.col("content_hash").alias("old"))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("new") == F.col("old"), "skip").otherwise("update")
    return new.join(old, "id", "full_outer").select("id", action.alias("action"))


def orphans(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(parsed.select("id"), "id", "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """stored with the rows of new in place of those with the same key; the columns in keep stay as stored."""
    kept = stored.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    fresh = new.join(kept, key, "left")
    fresh = fresh.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in stored.columns])
    return stored.join(new.select(key), key, "left_anti").select(*stored.columns).unionByName(fresh)


def duplicates(names: DataFrame, key: str = "name") -> DataFrame:
    return names.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
