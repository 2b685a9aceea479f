"""Tables in the shared folder, and joins that a hot key does not slow down."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at once.
SLICE_BYTES = 1 << 19
_local: dict[str, str] = {}
_owned: list[list[str]] = []
#: What operators remember in a Python worker from task to task, by operator: how to forget it.
_memories: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    _memories[operator] = forget


def forget_others(operator: str) -> None:
    """In a worker: give back what other operators remember there. Workers serve one stage of a pipeline after the other."""
    import pyarrow as pa

    for name, forget in _memories.items():
        if name != operator:
            forget()
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a URI: spark.checkpoint.dir on the file system that Hadoop resolves it to.

    Where that is unset, a temporary folder serves a local master (tests); on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors need a shared folder")
        base = _local.get("dir")
        if not base:
            base = _local["dir"] = "file://" + (made := tempfile.mkdtemp(prefix="docfathom-"))
            atexit.register(shutil.rmtree, made, ignore_errors=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full[5:]
    return full.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docfathom/{name}-{uuid.uuid4().hex}"
    for made in _owned:
        made.append(path)
    return path


@contextmanager
def owner(spark: SparkSession):
    """Collects the paths made inside, and deletes them at the end but for those taken out of the list: their tables are done with."""
    made: list[str] = []
    _owned.append(made)
    try:
        yield made
    finally:
        _owned[:] = [x for x in _owned if x is not made]
        for path in made:
            _delete(spark, path)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: a cut of the lineage that survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docfathom_path = path
    return back


def path_of(staged: DataFrame) -> str:
    return staged._docfathom_path


def discard(*staged: DataFrame) -> None:
    """Delete tables of stage() that nothing reads any more."""
    for df in staged:
        _delete(df.sparkSession, path_of(df))


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that go to Python in one batch; the workers cut batches further by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def split_join(big: DataFrame, unique: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join big with unique (staged; one row per key; weight: that key's rows in big) on key.

    Keys with more than a thousandth of all rows (so fewer than 1000 of them) are broadcast; the others are shuffled. Null keys of big
    match nothing: a left join keeps them, without a shuffle. If all keys are of one sort, big is read once.
    """
    hot = F.col(weight) > max(1, total // 1000)
    n = unique.agg(F.count_if(hot).alias("hot"), F.count_if(~hot).alias("cold")).first()
    small = F.broadcast(unique.filter(hot))
    if not n["cold"]:
        return big.join(small, key, how)
    rest = big.filter(F.col(key).isNotNull())
    if n["hot"]:
        rest = rest.join(small.select(key), key, "left_anti")
    out = rest.join(unique.filter(~hot), key, how)
    if how == "left":
        known = big.join(small, key, how).filter(F.col(key).isNull() | F.col(weight).isNotNull())
        return known.unionByName(out)
    return big.join(small, key).unionByName(out) if n["hot"] else out


def slices(batch, column: str, size: int = SLICE_BYTES):
    """Cut an Arrow batch into runs of rows with at most size bytes of column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at, n = np.cumsum(lengths, dtype=np.int64), 0, batch.num_rows
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def filesystem(uri: str):
    """(file system, path) of a shared folder, for workers that read or write files in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def carried(docs: DataFrame, columns) -> tuple[list, list]:
    """Columns under names that clash with none (for a pass through Python), and the fields of the result."""
    from pyspark.sql import types as T

    fields = [T.StructField(f"carry{i}", docs.schema[c].dataType) for i, c in enumerate(columns)]
    return [F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(columns)], fields


def uncarried(df: DataFrame, columns) -> list:
    return [F.col(f"carry{i}").alias(c) for i, c in enumerate(columns)]
