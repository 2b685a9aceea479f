"""Best-fit-decreasing packing of token sequences.

Best fit needs only the lengths. The corpus is reduced to one count per length (at most `capacity` of them); the driver runs best-fit
decreasing over those counts with a segment tree over remaining capacities, placing all documents of a length that meet the same
kind of open bin in one step, just as placing them one by one would. The plan is a list of runs (length, ranks, bins); each document
finds its place from its rank among the documents of its length.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange, shared


class CapacityTree:
    """Which remaining capacities open bins have: a segment tree that finds the least one of at least a length in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, value: int, there: bool) -> None:
        i = value + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least_from(self, value: int) -> int | None:
        i = value + self.size
        while not self.any[i]:
            while i & 1:  # a right child: the next subtree to the right hangs higher up
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts by length.

    Returns runs (length, first rank, first bin, documents in each bin, offset in the bins), ascending by length and rank, and the
    number of bins. From its first rank on, a run fills one bin after the other.
    """
    tree = CapacityTree(capacity)
    bins: dict[int, deque] = {}
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0:
            if not bins.setdefault(room, deque()):
                tree.set(room, True)
            bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.least_from(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins[room].popleft()
            each = room // length
            full = min(n, left // each)
            part = left - full * each if full < n else 0
            part = min(part, each)
            used = full + (part > 0)
            runs.append((length, rank, first, each, capacity - room))
            put(room - each * length, first, full) if full else None
            if part:
                put(room - part * length, first + full, 1)
            if room < capacity:
                if used < n:
                    bins[room].appendleft((first + used, n - used))
                elif not bins[room]:
                    tree.set(room, False)
            rank += full * each + part
            left -= full * each + part
    return sorted(runs), opened


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        from .tokens import encoder

        encode, block = encoder(path).encode, TaskContext.get().partitionId()
        seen, end = np.zeros(capacity + 1, np.int64), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in shared.slices(batch, "text"):
                row, piece, start, length, rank, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own = encode(text or "") + end
                    for k, at in enumerate(range(0, len(own) // 4, capacity)):
                        n = min(capacity, len(own) // 4 - at)
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        rank.append(int(seen[n]))
                        seen[n] += 1
                        ids.append(own[4 * at : 4 * (at + n)])
                yield pa.record_batch(
                    [pa.array([block] * len(row), pa.int32()), part.column("id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(rank, pa.int64()), pa.array(ids, pa.binary())],
                    names=["block", "id", "piece", "start", "length", "rank", "ids"],
                )

    return run


def _place(bases: str, runs: np.ndarray, capacity: int):
    key = runs[:, 0] * (1 << 44) + runs[:, 1]

    def run(batches):
        block, base = None, np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for b, part in exchange.by_block(batch):
                if b != block:
                    base = np.zeros(capacity + 1, np.int64)
                    got = exchange.read_block(bases, b, ["length", "base"])
                    base[np.array(got["length"], np.int64)] = got["base"]
                    block = b
                length = part.column("length").to_numpy()
                rank = part.column("rank").to_numpy() + base[length]
                at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
                nth = rank - runs[at, 1]
                out = part.select(["id", "piece", "start", "length", "ids"])
                yield pa.record_batch(
                    [*out.columns, pa.array(runs[at, 2] + nth // runs[at, 3]), pa.array(runs[at, 4] + nth % runs[at, 3] * length)],
                    names=[*out.schema.names, "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all texts into as few sequences of at most capacity tokens as best-fit decreasing needs.

    A text's tokens are its ids by the tokenizers file `tokenizer` (a path that every executor has), without special tokens, and end_id.
    Longer ones are cut into pieces of capacity tokens, the last may be shorter; no other is cut. A null text is empty, so end_id alone;
    equal rows and null ids are packed like any row; other columns are not read. An empty table gives no rows.

    Returns id_col, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset. Sequences have no gaps.
    """
    from .tokens import default_path

    spark = docs.sparkSession
    shared.small_batches(spark)
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = shared.stage(rows.mapInArrow(_tokenise(tokenizer or default_path(), capacity, end_id), f"block int, id {kind}, piece int, start long, length long, rank long, ids binary"), "pieces")
    by_block = shared.stage(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_block.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = shared.stage(bases.repartition(F.col("block")), "bases", "block")
    table = np.array(runs, np.int64).reshape(-1, 5)
    out = pieces.mapInArrow(_place(shared.path_of(bases), table, capacity), f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
