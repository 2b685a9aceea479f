"""Which hashes occur more than once in the corpus, without moving texts and without hot keys.

A staged table is cut into blocks (the partitions it was written from). Each block sends every distinct hash once, in one binary value
per range of hashes; the range's task merges the sorted arrays and sends each block back those of its hashes that occur elsewhere
too. A hash that a third of all rows hold is one entry per block. The answers are files in the shared folder, one folder per block,
and the next pass over the block reads its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .hashing import mix

SENT = "r int, block int, n long, hashes binary, twice binary"
BACK = "block int, hashes binary"
_BACK_ARROW = pa.schema([("block", pa.int32()), ("hashes", pa.binary())])


def blocks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Stage df with a column block, the partition that a row was written from; and the number of blocks.

    As many ranges as blocks keep a range's task as large as a block's.
    """
    staged = shared.stage(df.withColumn("block", F.spark_partition_id()), name)
    return staged, (staged.agg(F.max("block")).first()[0] or 0) + 1


def sent_rows(block: int, hashes: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Rows of SENT for all hashes (one entry per occurrence) of a block. They are mixed once more: least hashes crowd near zero."""
    hashes, counts = np.unique(mix(hashes.copy()), return_counts=True)
    cuts = np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
    rows = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.record_batch(
        [
            pa.array([r for r, _, _ in rows], pa.int32()),
            pa.array([block] * len(rows), pa.int32()),
            pa.array([int(b - a) for _, a, b in rows], pa.int64()),
            pa.array([hashes[a:b].tobytes() for _, a, b in rows], pa.binary()),
            pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in rows], pa.binary()),
        ],
        names=["r", "block", "n", "hashes", "twice"],
    )


def _merge(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("twice"), parts, strict=True)]
    every = np.sort(np.concatenate(parts))
    again = np.concatenate([every[1:][every[1:] == every[:-1]], *[p[t] for p, t in zip(parts, twice, strict=True)]])
    again = np.unique(again)
    block, out = [], []
    for b, p in zip(table.column("block").to_pylist(), parts, strict=True):
        hit = p[_within(p, again)]
        if len(hit):
            block.append(b)
            out.append(hit.tobytes())
    return pa.table([pa.array(block, pa.int32()), pa.array(out, pa.binary())], schema=_BACK_ARROW)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array ordered."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def found(hashes: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Which hashes are among a block's answers."""
    return _within(mix(hashes.copy()), answers)


def repeated(sent: DataFrame, name: str) -> DataFrame:
    """The staged answers to sent (rows of SENT): for each block its hashes that occur more than once in all blocks."""
    back = sent.groupBy("r").applyInArrow(_merge, BACK)
    return shared.stage(back.repartition(F.col("block")), name, "block")


class Answers:
    """Reads, in a worker, the answers for a block, for found(); keeps the last block's."""

    def __init__(self, path: str):
        self.path, self.block, self.hashes = path, None, np.zeros(0, np.uint64)

    def of(self, block: int) -> np.ndarray:
        if block != self.block:
            rows = read_block(self.path, block, ["hashes"])
            parts = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
            self.hashes = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            self.block = block
        return self.hashes


def read_block(path: str, block: int, columns: list[str]) -> dict[str, list]:
    """The rows of one block's folder of a table staged with partition_by="block"."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = shared.filesystem(path)
    found: dict[str, list] = {c: [] for c in columns}
    for f in sorted(system.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                table = pq.ParquetFile(source).read(columns=columns)
            for c in columns:
                found[c] += table.column(c).to_pylist()
    return found


def by_block(batch: pa.RecordBatch):
    """(block, rows) for each run of equal blocks in a batch."""
    shared.forget_others("exchange")
    ids = batch.column("block").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(ids[a]), batch.slice(a, b - a)
